"""The notices that operator 6 seeks: texts as their licences publish them, and SPDX lines built from identifiers."""

from __future__ import annotations

import re

_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions:"
)
_MIT_REST = (
    " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, "
    "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "{0}Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "{1}Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_GNU = "This {0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation; either version {2} of the License, or (at your option) any later version."
_CC = "This work is licensed under a Creative Commons {0} 4.0 International License"

#: Label, text, phrases that must stand.
TEXTS = (
    ("mit", "released under the MIT License", ("mit license",)),
    ("mit", "licensed under the MIT License", ("mit license",)),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ("hereby granted free of charge", "copy of this software")),
    ("mit", _MIT_GRANT, ("hereby granted free of charge", "publish distribute sublicense")),
    ("mit", _MIT_GRANT + _MIT_REST, ("hereby granted free of charge", "all copies or substantial portions of the software")),
    ("apache-2.0", "licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
     "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
     "See the License for the specific language governing permissions and limitations under the License.", ("apache license version 2 0", "without warranties or conditions of any kind")),
    ("gpl-3.0", "licensed under the GNU General Public License version 3", ("gnu general public license version 3",)),
    ("gpl-2.0", "licensed under the GNU General Public License version 2", ("gnu general public license version 2",)),
    ("gpl-3.0", _GNU.format("program", "General Public License", "3"), ("gnu general public license", "either version 3 of the license")),
    ("gpl-2.0", _GNU.format("program", "General Public License", "2"), ("gnu general public license", "either version 2 of the license")),
    ("lgpl", "under the terms of the GNU Lesser General Public License", ("gnu lesser general public license",)),
    ("lgpl-2.1", _GNU.format("library", "Lesser General Public License", "2.1"), ("gnu lesser general public license", "either version 2 1 of the license")),
    ("lgpl-3.0", _GNU.format("library", "Lesser General Public License", "3"), ("gnu lesser general public license", "either version 3 of the license")),
    ("agpl-3.0", "under the terms of the GNU Affero General Public License version 3", ("gnu affero general public license",)),
    ("agpl-3.0", _GNU.format("program", "Affero General Public License", "3"), ("gnu affero general public license", "either version 3 of the license")),
    ("cc-by-4.0", "licensed under CC BY 4.0", ("cc by 4 0",)),
    ("cc-by-sa-4.0", "licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    ("cc-by-nc-4.0", "licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    ("cc-by-nd-4.0", "licensed under CC BY-ND 4.0", ("cc by nd 4 0",)),
    ("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
    ("cc-by-sa-4.0", _CC.format("Attribution-ShareAlike"), ("creative commons attribution sharealike 4 0",)),
    ("cc-by-nc-4.0", _CC.format("Attribution-NonCommercial"), ("creative commons attribution noncommercial 4 0",)),
    ("cc-by-nd-4.0", _CC.format("Attribution-NoDerivatives"), ("creative commons attribution noderivatives 4 0",)),
    ("cc-by-nc-sa-4.0", _CC.format("Attribution-NonCommercial-ShareAlike"), ("creative commons attribution noncommercial sharealike 4 0",)),
    ("cc0-1.0", "CC0 1.0 Universal Public Domain Dedication", ("cc0 1 0",)),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright and related or neighboring rights",)),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("bsd-2-clause", _BSD.format("1. ", "2. "), ("redistribution and use in source and binary forms", "redistributions in binary form must reproduce")),
    ("bsd-2-clause", _BSD.format("", ""), ("redistribution and use in source and binary forms", "redistributions in binary form must reproduce")),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", ("may be used to endorse or promote products derived from this software",)),
    ("mpl-2.0", "subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license v 2 0",)),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", ("mozilla public license v 2 0", "a copy of the mpl was not distributed")),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify",)),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ("permission to use copy modify", "this permission notice appear in all copies")),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions", ("permission is granted to anyone to use this software",)),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0", ("boost software license version 1 0",)),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", ("eclipse public license 2 0",)),
    ("cddl-1.0", "The contents of this file are subject to the terms of the Common Development and Distribution License", ("common development and distribution license",)),
    ("ofl-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1", ("sil open font license version 1 1",)),
    ("artistic-2.0", "under the terms of the Artistic License 2.0", ("artistic license 2 0",)),
    ("wtfpl", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE", ("do what the fuck you want to public license",)),
    ("unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
     ("free and unencumbered software", "copy modify publish use compile sell or distribute this software")),
    ("proprietary", "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential", ("unauthorized copying of this file",)),
)

#: SPDX identifiers, sought behind the words of an SPDX line.
IDENTIFIERS = (
    "0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 "
    "CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.2 GFDL-1.3-only GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 "
    "LGPL-3.0-only LGPL-3.0-or-later LPPL-1.3c MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL NCSA ODbL-1.0 OFL-1.1 OSL-3.0 PostgreSQL Python-2.0 UPL-1.0 Unlicense WTFPL Zlib"
).split()


def words_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def notices() -> list[tuple[str, list[str], list[list[str]]]]:
    """Label, words and mandatory phrases of every notice; SPDX lines are mandatory whole."""
    found = [(label, words_of(text), [words_of(p) for p in phrases]) for label, text, phrases in TEXTS]
    for name in IDENTIFIERS:
        words = words_of("SPDX-License-Identifier: " + name)
        found.append((name.lower(), words, [words]))
    return found
