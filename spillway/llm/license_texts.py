"""Licence phrases and notices to look for.  Fixed values: public licence texts, label by label."""

#: Phrases that count only word for word.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: More phrases of the same kind.
MORE_PHRASES = {
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license version 2": "mpl-2",
    "eclipse public license": "epl",
    "boost software license": "bsl-1",
    "bsd 2 clause license": "bsd-2",
    "bsd 3 clause license": "bsd-3",
    "spdx license identifier mit": "mit",
    "spdx license identifier apache 2": "apache-2",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "public domain dedication": "cc0",
}

#: Notices, which may be changed a little.
NOTICES = {
    "mit": """
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software
        and associated documentation files (the "Software"), to deal in the Software without
        restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
        Software is furnished to do so, subject to the following conditions: The above copyright
        notice and this permission notice shall be included in all copies or substantial portions of
        the Software.""",
    "apache-2": """
        Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file
        except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
        writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
        WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
        specific language governing permissions and limitations under the License.""",
    "gpl-3": """
        This program is free software: you can redistribute it and/or modify it under the terms of
        the GNU General Public License as published by the Free Software Foundation, either version 3
        of the License, or (at your option) any later version.""",
    "gpl-2": """
        This program is free software; you can redistribute it and/or modify it under the terms of
        the GNU General Public License as published by the Free Software Foundation; either version 2
        of the License, or (at your option) any later version.""",
    "lgpl": """
        This library is free software; you can redistribute it and/or modify it under the terms of
        the GNU Lesser General Public License as published by the Free Software Foundation; either
        version 2.1 of the License, or (at your option) any later version.""",
    "agpl": """
        This program is free software: you can redistribute it and/or modify it under the terms of
        the GNU Affero General Public License as published by the Free Software Foundation, either
        version 3 of the License, or (at your option) any later version.""",
    "mpl-2": """
        This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy
        of the MPL was not distributed with this file, You can obtain one at
        https://mozilla.org/MPL/2.0/.""",
    "epl": """
        This program and the accompanying materials are made available under the terms of the Eclipse
        Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/""",
    "bsl-1": """
        Distributed under the Boost Software License, Version 1.0. (See accompanying file
        LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)""",
    "cc-by": """
        This work is licensed under a Creative Commons Attribution 4.0 International License.""",
    "cc-by-sa": """
        This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International
        License.""",
    "cc-by-nd": """
        This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International
        License.""",
    "cc-by-nc": """
        This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International
        License.""",
    "cc-by-nc-sa": """
        This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0
        International License.""",
    "cc-by-nc-nd": """
        This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0
        International License.""",
    "bsd-3": """
        Redistribution and use in source and binary forms, with or without modification, are
        permitted provided that the following conditions are met: Redistributions of source code must
        retain the above copyright notice, this list of conditions and the following disclaimer.
        Redistributions in binary form must reproduce the above copyright notice, this list of
        conditions and the following disclaimer in the documentation and/or other materials provided
        with the distribution. Neither the name of the copyright holder nor the names of its
        contributors may be used to endorse or promote products derived from this software without
        specific prior written permission.""",
    "bsd-2": """
        Redistribution and use in source and binary forms, with or without modification, are
        permitted provided that the following conditions are met: Redistributions of source code must
        retain the above copyright notice, this list of conditions and the following disclaimer.
        Redistributions in binary form must reproduce the above copyright notice, this list of
        conditions and the following disclaimer in the documentation and/or other materials provided
        with the distribution.""",
    "isc": """
        Permission to use, copy, modify, and/or distribute this software for any purpose with or
        without fee is hereby granted, provided that the above copyright notice and this permission
        notice appear in all copies.""",
    "unlicense": """
        This is free and unencumbered software released into the public domain. Anyone is free to
        copy, modify, publish, use, compile, sell, or distribute this software, either in source code
        form or as a compiled binary, for any purpose, commercial or non-commercial, and by any
        means.""",
}

#: Words of a notice that tell it from others, which share nearly all the rest.
DECISIVE = {
    "gpl-2": ("gnu general", "version 2"),
    "gpl-3": ("gnu general", "version 3"),
    "lgpl": ("lesser",),
    "agpl": ("affero",),
    "mpl-2": ("mozilla",),
    "epl": ("eclipse",),
    "bsl-1": ("boost software",),
    "cc-by": ("attribution 4",),
    "cc-by-sa": ("attribution sharealike 4",),
    "cc-by-nd": ("attribution noderivatives 4",),
    "cc-by-nc": ("attribution noncommercial 4",),
    "cc-by-nc-sa": ("noncommercial sharealike",),
    "cc-by-nc-nd": ("noncommercial noderivatives",),
    "bsd-3": ("neither the name", "endorse or promote"),
    "mit": ("sublicense",),
    "isc": ("with or without fee",),
}
