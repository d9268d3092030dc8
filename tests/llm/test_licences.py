"""Licence texts as files have them: wrapped, in comments, with other holders' names; and the rules' SQL on the same rows."""

import duckdb
import pandas as pd

from stopwise.llm import licences

MIT = """MIT License

Copyright (c) 2021 Some Holder

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD2 = """ * Copyright (c) 2010, Someone
 * All rights reserved.
 *
 * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions are met:
 * 1. Redistributions of source code must retain the above copyright notice, this
 *    list of conditions and the following disclaimer.
 * 2. Redistributions in binary form must reproduce the above copyright notice,
 *    this list of conditions and the following disclaimer in the documentation
 *    and/or other materials provided with the distribution.
"""
DISCLAIMER = """ *
 * THIS SOFTWARE IS PROVIDED BY THE REGENTS AND CONTRIBUTORS "AS IS" AND
 * ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
 * WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
 * DISCLAIMED.
"""
BSD3 = BSD2 + """ * 3. Neither the name of the University nor the names of its
 *    contributors may be used to endorse or promote products derived from
 *    this software without specific prior written permission.
"""
APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
"""
GPL = """    This program is free software; you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation; either version 2 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
"""
LGPL = """ * Libthing is free software; you can redistribute it and/or
 * modify it under the terms of the GNU Lesser General Public
 * License as published by the Free Software Foundation; either
 * version 2.1 of the License, or (at your option) any later version.
"""
ISC = """Copyright 2004 Holder <h@example.org>

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS.
"""
MPL = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at http://mozilla.org/MPL/2.0/. */
"""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software.
"""
CASES = [
    (MIT, "MIT"),
    ("Words before it.\n\n" + MIT.split("\n\n", 2)[2] + "\nand words after it", "MIT"),
    (" ".join(MIT.split()), "MIT"),
    (BSD2 + DISCLAIMER, "BSD-2-Clause"),
    (BSD3 + DISCLAIMER, "BSD-3-Clause"),
    (BSD3.replace(" * 3. Neither", " * 3. All advertising materials mentioning features or use of this software\n *    must display the following acknowledgement:\n *    by someone.\n * 4. Neither"), "BSD-4-Clause"),
    (APACHE, "Apache-2.0"),
    (APACHE.replace("# ", "").replace("#", ""), "Apache-2.0"),
    (GPL, "GPL-2.0-or-later"),
    (GPL.replace("; you", ": you").replace("version 2", "version 3"), "GPL-3.0-or-later"),
    (LGPL, "LGPL-2.1-or-later"),
    (LGPL.replace("Lesser", "Affero").replace("2.1", "3"), "AGPL-3.0-or-later"),
    (ISC, "ISC"),
    (MPL, "MPL-2.0"),
    (ZLIB, "Zlib"),
    ("x = 1  # SPDX-License-Identifier: GPL-3.0-only OR MIT\ny = 2", "GPL-3.0-only,MIT"),
    ("/* SPDX-License-Identifier: (Apache-2.0 WITH LLVM-exception) AND BSD-3-Clause */", "Apache-2.0,BSD-3-Clause,LLVM-exception"),
    ("// SPDX-License-Identifier: GPL-2.0+", "GPL-2.0-or-later"),
    ("Licensed under the MIT license, see LICENSE.", "MIT"),
    ("The whole of this package and each file in it, unless a file says something else, is licensed under the ISC license (see LICENSE file)", "ISC"),
    ("Dual-licensed under either of Apache License, Version 2.0 or MIT license at your option.", "Apache-2.0,MIT"),
    ("This library is free software; you can redistribute it and/or modify it under the same terms as Perl itself.", "Artistic-1.0-Perl OR GPL-1.0-or-later"),
    ("Distributed under the Boost Software License, Version 1.0.\n(See accompanying file LICENSE_1_0.txt or copy at\nhttp://www.boost.org/LICENSE_1_0.txt)", "BSL-1.0"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 3.0 Unported License.", "CC-BY-NC-SA-3.0"),
    ("All content is available under CC BY-SA 4.0, photos too.", "CC-BY-SA-4.0"),
    ("This is free and unencumbered software released into the public domain.", "Unlicense"),
    ("It was released under GPLv3 last year", "GPL-3.0"),
    ("released under the BSD 3-Clause License", "BSD-3-Clause"),
    ("MIT License", "MIT"),
    ("The MIT License is short and people like it.", ""),
    ("He went under the bridge to the software shop and asked for a copy.", ""),
    ("We were released under mitigating circumstances.", ""),
    (None, ""), ("", ""), (" \n\t\n", ""), ("\n" * 50_000, ""), ("copy " * 60_000, ""), ("a" * 300_000 + " under", ""),
    ("\n\n".join([MIT, APACHE, GPL] * 40), "MIT,Apache-2.0,GPL-2.0-or-later"),
]


def as_set(value):
    return set(filter(None, value.split(",")))


def test_licence_files_and_notices(spark):
    rows = spark.createDataFrame([(k, t, "x", 3) for k, (t, _) in enumerate(CASES)] + [(None, MIT, None, None), (0, MIT, "x", 3)], "doc_id long, text string, licences string, ids int")
    got = [(r.doc_id, r.licences) for r in licences.scanned(rows).collect()]
    assert len(got) == len(CASES) + 2
    assert {k: as_set(v) for k, v in got if k is not None} == {k: as_set(want) for k, (_, want) in enumerate(CASES)}
    assert ("MIT", 2) in {(v, sum(x == (0, v) for x in got)) for _, v in got} and (None, "MIT") in got


def test_sql_gives_the_same_rows(spark):
    frame = pd.DataFrame({"doc_id": range(len(CASES)), "text": [t for t, _ in CASES]})
    con = duckdb.connect()
    con.register("documents", frame)
    want = sorted(con.sql(licences.scan_sql()).fetchall())
    got = sorted(tuple(r) for r in licences.scanned(spark.createDataFrame(list(enumerate(t for t, _ in CASES)), "doc_id long, text string")).collect())
    assert got == want


def test_tables_are_normal_and_pass_the_gates():
    for known in (licences.NAMED, licences.INSIDE, licences.WHOLE):
        for text in known:
            assert licences.normal(text) == text
            assert any(t in text for t in licences.TRIGGERS) or text.startswith("cc "), text  # written creative commons
    assert len(licences.NAMED) + len(licences.INSIDE) > 300 and len(licences.ALL_RULES) > 150
