"""Licence texts and notices as they stand in public repositories; none is taken from the test data."""

import pytest

from pdengine.llm import licenses

BSD = """Copyright (c) 2019, Jo Doe
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
NAMES = """{} Neither the name of {} nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
ADVERTISING = """3. All advertising materials mentioning features or use of this software
   must display the following acknowledgement:
   This product includes software developed by the University of
   California, Berkeley and its contributors.
"""
DISCLAIMER = '\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"\nAND ANY EXPRESS OR IMPLIED WARRANTIES\n'
GNU = """ * This library is free software; you can redistribute it and/or
 * modify it under the terms of the GNU Lesser General Public
 * License as published by the Free Software Foundation; either
 * version 2.1 of the License, or (at your option) any later version.
"""
GRANT = licenses.SENTENCES["mit-grant"]
CASES = [
    (BSD + DISCLAIMER, ["BSD-2-Clause"]),
    (BSD + NAMES.format("3.", "the copyright holder") + DISCLAIMER, ["BSD-3-Clause"]),
    (BSD.replace("1.", "(a)").replace("2.", "(b)") + NAMES.format("(c)", "Foo, Inc."), ["BSD-3-Clause"]),
    (BSD.replace("1.", "*").replace("2.", "*") + ADVERTISING + NAMES.format("4.", "the University"), ["BSD-4-Clause"]),
    (BSD[: BSD.index("1.")] + "Be nice.", ["BSD"]),
    (GNU, ["LGPL-2.1-or-later"]),
    ("GCC is free software; you can redistribute it and/or modify it under\nthe terms of the GNU General Public License as published by the Free\n"
     "Software Foundation; either version 3, or (at your option) any later\nversion.", ["GPL-3.0-or-later"]),
    ("This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License version 2 as\n"
     "published by the Free Software Foundation.", ["GPL-2.0-only"]),
    (GNU.replace("Lesser General", "Affero General").replace("2.1", "3"), ["AGPL-3.0-or-later"]),
    ("          GNU GENERAL PUBLIC LICENSE\n             Version 2, June 1991\n\n Copyright (C) 1989, 1991", ["GPL-2.0-only"]),
    ("GNU LESSER GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n", ["LGPL-3.0-only"]),
    ("GNU AFFERO GENERAL PUBLIC LICENSE\n   Version 3, 19 November 2007\n", ["AGPL-3.0-only"]),
    ("/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL", ["MPL-2.0"]),
    ("Eclipse Public License - v 2.0\n\n    THE ACCOMPANYING PROGRAM", ["EPL-2.0"]),
    ("Permission to use, copy, modify, and distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\n"
     "copyright notice and this permission notice appear in all copies.", ["ISC"]),
    ("This is free and unencumbered software released into the public domain.\n\nAnyone is free", ["Unlicense"]),
    ("Permission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\n"
     "freely, subject to the following restrictions:\n\n1. The origin", ["Zlib"]),
    ("// Distributed under the Boost Software License, Version 1.0.\n// (See accompanying file", ["BSL-1.0"]),
    ("Business Source License 1.1\n\nParameters", ["BUSL-1.1"]),
    ('Licensed under the Apache License, Version 2.0 (the "License").\nSomething else.', ["Apache-2.0"]),
    ('# Licensed under the Apache License, Version 2.0 (the "License");\n# you may not use this file except in compliance with the License.\n'
     "# You may obtain a copy of the License at\n#\n#   https://www.apache.org/licenses/LICENSE-2.0\n#", ["Apache-2.0"]),
    (GRANT + " Something else.", ["MIT"]),
    (GRANT + "\n\nThe above copyright notice and this permission notice (including the next\nparagraph) shall be included", ["MIT"]),
    ("This project is licensed under the MIT License - see the [LICENSE](LICENSE) file", ["MIT"]),
    ("Licensed under either of MIT or Apache-2.0.", ["MIT", "Apache-2.0"]),
    ("Licensed under the GPLv2+.", ["GPL-2.0-or-later"]),
    ("Released under the GNU GPL v3.", ["GPL-3.0-only"]),
    ("This work is licensed under a Creative Commons\nAttribution-ShareAlike 4.0 International License.", ["CC-BY-SA-4.0"]),
    ("// SPDX-License-Identifier: MIT\n", ["MIT"]),
    ("/* SPDX-License-Identifier: GPL-2.0+ */", ["GPL-2.0-or-later"]),
    ("# SPDX-License-Identifier: (GPL-2.0 WITH Linux-syscall-note) OR BSD-3-Clause\n", ["GPL-2.0-only WITH Linux-syscall-note", "BSD-3-Clause"]),
    ("SPDX-License-Identifier: apache-2.0 AND (MPL-2.0 OR LicenseRef-mine)", ["Apache-2.0", "MPL-2.0", "LicenseRef-mine"]),
    # no licence is named
    ("SPDX-License-Identifier: <tag>", []), ("SPDX-License-Identifier: NOASSERTION", []),
    ("He may license it under the MIT licence terms he likes", []), ("Redistributions of source code must retain the above", []),
    ("Permission to leave was granted. The GPL is a licence.", []),
]


@pytest.mark.parametrize("text, expected", CASES)
def test_usual_licences(text, expected):
    scanner = licenses.Scanner()
    for whole in (text, f"Some words before.\n\n{text}\n\nSome words after."):
        got = scanner.licences(whole)
        assert [n for n, _, _ in got] == expected
        assert all(0 <= a < b <= len(whole) and not whole[a].isspace() for _, a, b in got)
