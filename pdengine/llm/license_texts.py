"""Known sentences and rules of the licence scan. The wording of the public licences and their usual notices.

``…`` within a sentence stands for one to twelve words that differ (a holder's
name); at its end, for the words up to the next sentence border.
"""

from __future__ import annotations

SENTENCES = {
    "apache-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-file": 'Licensed under the Apache License, Version 2.0 (the "License").',
    "apache-use": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "mit-notice": "Released under the MIT License.",
    "mit-title": "The MIT License (MIT)",
    "mit-title-short": "MIT License",
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    ),
    "mit-notice-kept": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "cc-by-nc-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-notice": "Licensed under CC BY-SA 4.0.",
    "cc0-notice": "This work is dedicated to the public domain.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "apache-copy-https": "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": (
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
        "disclaimer in the documentation and/or other materials provided with the distribution."
    ),
    "bsd-advertising": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "bsd-advertising-us": "All advertising materials mentioning features or use of this software must display the following acknowledgment:",
    "bsd-product": "This product includes software developed by …",
    "bsd-names": (
        "Neither the name of … nor the names of … may be used to endorse or promote products derived from this software "
        "without specific prior written permission."
    ),
    "bsd-author": "The name of … may not be used to endorse or promote products derived from this software without specific prior written permission.",
    "mit0-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so."
    ),
    "json-good": "The Software shall be used for Good, not Evil.",
}
_MIT, _BSD = ("mit-grant", "mit-notice-kept"), ("bsd-grant", "bsd-source", "bsd-binary")
#: Licence and the sentences that name it, in order.
RULES = [
    ("Apache-2.0", ("apache-file", "apache-use", "apache-copy")),
    ("MIT", ("mit-title", *_MIT)),
    ("MIT", ("mit-title-short", *_MIT)),
    ("MIT", _MIT),
    ("Apache-2.0", ("apache-file", "apache-use")),
    ("Apache-2.0", ("apache-notice",)),
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-title",)),
    ("MIT", ("mit-title-short",)),
    ("GPL-3.0-only", ("gpl3-notice",)),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-notice",)),
    ("CC-BY-4.0", ("cc-by-notice",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-notice",)),
    ("CC0-1.0", ("cc0-notice",)),
    ("BSD", ("bsd-grant",)),
    # parts of notices that stand alone
    ("Apache-2.0", ("apache-file", "apache-use", "apache-copy-https")),
    ("Apache-2.0", ("apache-file",)),
    ("Apache-2.0", ("apache-copy",)),
    ("Apache-2.0", ("apache-copy-https",)),
    ("MIT", ("mit-grant",)),
    ("MIT-0", ("mit0-grant",)),
    ("JSON", (*_MIT, "json-good")),
    ("BSD-2-Clause", _BSD),
    ("BSD-3-Clause", (*_BSD, "bsd-names")),
    ("BSD-3-Clause", (*_BSD, "bsd-author")),
    *(("BSD-4-Clause", (*_BSD, a, "bsd-product", n)) for a in ("bsd-advertising", "bsd-advertising-us") for n in ("bsd-names", "bsd-author")),
]
#: Texts that name a licence by themselves: titles, opening sentences, file notices.
_TEXTS = {
    "Apache-2.0": ("Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", "Apache License Version 2.0, January 2004"),
    "GPL-1.0-only": ("GNU GENERAL PUBLIC LICENSE Version 1, February 1989",),
    "GPL-2.0-only": ("GNU GENERAL PUBLIC LICENSE Version 2, June 1991",),
    "GPL-3.0-only": ("GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",),
    "LGPL-2.0-only": ("GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991",),
    "LGPL-2.1-only": ("GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",),
    "LGPL-3.0-only": ("GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",),
    "AGPL-3.0-only": ("GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "MPL-1.1": (
        'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License");',
        'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "MPL");',
    ),
    "EPL-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which …",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which …",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0 which …",
    ),
    "EPL-1.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which …",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 1.0 which …",
    ),
    "ISC": tuple(
        f"Permission to use, copy, modify, {a} distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies." for a in ("and/or", "and")
    ),
    "0BSD": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "Zlib": (
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter "
        "it and redistribute it freely, subject to the following restrictions:",
    ),
    "BSL-1.0": (
        "Boost Software License - Version 1.0 - August 17th, 2003",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
        'accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, '
        "and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the "
        "Software is furnished to do so, all subject to the following:",
    ),
    "NCSA": ("University of Illinois/NCSA Open Source License",),
    "WTFPL": ("DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",),
    "OFL-1.1": ("SIL OPEN FONT LICENSE Version 1.1 - 26 February 2007",),
    "CC0-1.0": ("CC0 1.0 Universal", "To the extent possible under law, … has waived all copyright and related or neighboring rights to …"),
}
#: Names of licences in notices. Those that hold the word licence are also known as titles.
_NAMES = {
    "MIT": ("MIT License", "MIT", "MIT/Expat License", "Expat License"),
    "Apache-2.0": (
        "Apache License, Version 2.0", "Apache License 2.0", "Apache License v2.0", "Apache License, v. 2.0", "Apache License v2",
        "Apache Software License, Version 2.0", "Apache Software License 2.0", "Apache 2.0 License", "Apache 2 License",
        "Apache-2.0 License", "Apache 2.0", "Apache v2.0", "Apache v2",
    ),
    "Apache-1.1": ("Apache License, Version 1.1", "Apache Software License, Version 1.1"),
    "BSD": ("BSD License", "BSD-style License", "BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "Two-Clause BSD License", "Simplified BSD License", "FreeBSD License", "BSD-2-Clause", 'BSD 2-Clause "Simplified" License'),
    "BSD-3-Clause": (
        "BSD 3-Clause License", "3-Clause BSD License", "Three-Clause BSD License", "New BSD License", "Modified BSD License",
        "Revised BSD License", "BSD-3-Clause", 'BSD 3-Clause "New" or "Revised" License',
    ),
    "BSD-4-Clause": ("BSD 4-Clause License", "4-Clause BSD License", "Original BSD License", "BSD-4-Clause"),
    "0BSD": ("Zero-Clause BSD License", "BSD Zero Clause License", "0BSD License", "0BSD"),
    "ISC": ("ISC License", "ISC"),
    "Zlib": ("zlib License", "zlib/libpng License", "zlib"),
    "Unlicense": ("Unlicense",),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0", "Boost Software License", "BSL-1.0"),
    "BUSL-1.1": ("Business Source License 1.1", "Business Source License, Version 1.1", "Business Source License v1.1", "BUSL-1.1"),
    "MPL-2.0": ("Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License v2.0", "MPL 2.0", "MPL v2.0", "MPLv2", "MPLv2.0"),
    "MPL-1.1": ("Mozilla Public License, Version 1.1", "Mozilla Public License 1.1", "MPL 1.1"),
    "EPL-2.0": ("Eclipse Public License, Version 2.0", "Eclipse Public License 2.0", "Eclipse Public License - v 2.0", "Eclipse Public License v2.0", "EPL 2.0", "EPL v2.0"),
    "EPL-1.0": ("Eclipse Public License, Version 1.0", "Eclipse Public License 1.0", "Eclipse Public License - v 1.0", "Eclipse Public License v1.0", "EPL 1.0", "EPL v1.0"),
    "CDDL-1.0": ("Common Development and Distribution License (CDDL) Version 1.0", "Common Development and Distribution License 1.0", "CDDL 1.0"),
    "CDDL-1.1": ("Common Development and Distribution License (CDDL) Version 1.1", "Common Development and Distribution License 1.1", "CDDL 1.1"),
    "Artistic-2.0": ("Artistic License 2.0", "Artistic License, Version 2.0"),
    "EUPL-1.2": ("European Union Public License 1.2", "European Union Public License v. 1.2", "EUPL 1.2", "EUPL v1.2"),
    "MS-PL": ("Microsoft Public License (Ms-PL)", "Microsoft Public License"),
    "NCSA": ("NCSA License", "University of Illinois/NCSA License"),
    "OFL-1.1": ("SIL Open Font License, Version 1.1", "SIL Open Font License 1.1", "Open Font License 1.1"),
    "PSF-2.0": ("Python Software Foundation License Version 2", "PSF License Version 2"),
    "WTFPL": ("WTFPL License", "WTFPL"),
    "CC0-1.0": ("CC0 1.0 Universal License", "CC0 1.0", "CC0", "Creative Commons Zero v1.0 Universal License", "Creative Commons CC0 1.0 Universal License"),
    # a notice without a version leaves the choice of any
    "GPL-1.0-or-later": ("GNU General Public License", "GNU GPL", "GPL"),
    "LGPL-2.0-or-later": ("GNU Lesser General Public License", "GNU Library General Public License", "GNU LGPL", "LGPL"),
    "AGPL-3.0-or-later": ("GNU Affero General Public License", "GNU AGPL", "AGPL"),
}
_NO_VERSION = {"GPL-1.0-or-later", "LGPL-2.0-or-later", "AGPL-3.0-or-later"}
#: Family: long name and versions.
_GNU = {
    "GPL": ("General Public License", ("1.0", "2.0", "3.0")),
    "LGPL": ("Lesser General Public License", ("2.0", "2.1", "3.0")),
    "AGPL": ("Affero General Public License", ("3.0",)),
}
_LATER = ("or later", "or later version", "or any later version", "or (at your option) any later version", "or newer")
for _family, (_long, _versions) in _GNU.items():
    for _v in _versions:
        _short = _v.removesuffix(".0")
        _only, _later = f"{_family}-{_v}-only", f"{_family}-{_v}-or-later"
        _longs = [_long, "Library General Public License"] if _only == "LGPL-2.0-only" else [_long]
        _these = [f"{n} {k}{x}" for n in (*(f"GNU {name}" for name in _longs), f"GNU {_family}", _family) for k in ("", "v", "v. ", "version ") for x in {_short, _v}]
        _these += [f"{g}{_family}v{x}{k}" for g in ("", "GNU ") for x in {_short, _v} for k in ("", " License")] + [f"{_family}-{_v} License"]
        _NAMES[_only] = (*_these, *(f"{n} only" for n in _these))
        _NAMES[_later] = tuple(f"{n} {k}" for n in _these for k in _LATER)
        for _n in _longs:
            _head = f"you can redistribute it and/or modify it under the terms of the GNU {_n}"
            _by = "as published by the Free Software Foundation"
            _forms = [f"{k}{x}" for k in ("version ", "v") for x in {_short, _v}]
            _TEXTS[_only] = (
                *_TEXTS.get(_only, ()),
                *(f"{_head} {x} {_by}." for x in _forms), *(f"{_head}, {x}, {_by}." for x in _forms),
                *(f"{_head} {_by}, {x}{k}." for x in _forms for k in ("", " of the License", " only", " of the License only")),
            )
            _TEXTS[_later] = (
                *_TEXTS.get(_later, ()),
                *(f"{_head} {_by}, {e}{x}{k}, {o}." for e in ("either ", "") for x in _forms for k in ("", " of the License") for o in _LATER[2:4]),
                *(f"{_head} {x}{k}, {o}, {_by}." for x in _forms for k in ("", " of the License") for o in _LATER[:4]),
            )
for _code, _long in {
    "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}.items():
    for _v, _kind in (("4.0", "International"), ("3.0", "Unported"), ("2.5", "Generic"), ("2.0", "Generic")):
        _all = {_long, _long.replace("Derivatives", "Derivs"), _long.replace("Share", "Share ")}
        _NAMES[f"CC-{_code}-{_v}"] = (
            f"CC {_code} {_v}", f"CC {_code} {_v} License", f"CC {_code} {_v} {_kind}",
            *(f"Creative Commons {n} {_v}{k}{e}" for n in sorted(_all) for k in ("", f" {_kind}") for e in ("", " License", " Public License")),
        )
_THINGS = ("work", "project", "software", "program", "library", "package", "code", "file", "document", "module", "repository")
#: How a notice begins.
_LEADS = (
    *(f"{k} under" for k in ("Licensed", "Released", "Distributed", "Available", "Published", "Made available", "Provided")),
    *(f"{k} under the terms of" for k in ("Licensed", "Released", "Distributed", "Available")),
    *(f"This {t} is {k} under" for t in _THINGS for k in ("licensed", "released", "distributed")),
    *(f"This {t} is {k} under the terms of" for t in _THINGS for k in ("licensed", "released", "distributed")),
    "License", "Code license", "Project license",
)
for _licence, _some in _TEXTS.items():
    for _i, _text in enumerate(_some):
        SENTENCES[f"{_licence} text {_i}"] = _text
        RULES.append((_licence, (f"{_licence} text {_i}",)))
#: Names as words that follow a lead and an article, or stand alone as a title where ``title`` says so.
NAMES = [
    (_name, _licence, _licence not in _NO_VERSION and ("License" in _name or _name == "Unlicense")) for _licence, _some in _NAMES.items() for _name in _some
]
LEADS, ARTICLES = _LEADS, ("the", "a", "an", "either", "both", "of")
RULES = tuple(RULES)

#: SPDX identifiers, written as the SPDX list has them.
SPDX = {k.lower(): k for k in [
    *(n for n in (*_NAMES, *_TEXTS) if n != "BSD"), "MIT-0", "JSON",
    *"""0BSD AFL-3.0 Apache-1.0 APSL-2.0 Artistic-1.0 Artistic-1.0-Perl BSD-1-Clause BSD-2-Clause-Patent BSD-3-Clause-Clear
    BSD-3-Clause-LBNL BSD-Source-Code BlueOak-1.0.0 Beerware CECILL-2.1 CECILL-B CECILL-C CPAL-1.0 CPL-1.0 curl ECL-2.0 EFL-2.0
    EUDatagrid EUPL-1.1 FSFAP FSFUL FTL HPND ICU IJG ImageMagick Info-ZIP Intel IPL-1.0 LPL-1.02 LPPL-1.3c Libpng libtiff
    Linux-OpenIB MirOS MS-RL MulanPSL-2.0 Multics Naumen NASA-1.3 NTP Nokia ODbL-1.0 ODC-By-1.0 OGL-UK-3.0 OLDAP-2.8 OpenSSL
    OSL-3.0 PDDL-1.0 PHP-3.01 PostgreSQL Python-2.0 QPL-1.0 RPL-1.5 RSCPL Ruby SISSL SSPL-1.0 Sleepycat SMLNJ TCL UPL-1.0
    Unicode-DFS-2016 Unicode-3.0 UCL-1.0 Vim VSL-1.0 W3C Watcom-1.0 X11 Xnet ZPL-2.1 bzip2-1.0.6 zlib-acknowledgement""".split(),
]}
