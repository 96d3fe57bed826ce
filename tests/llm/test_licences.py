"""Headers and licence files as projects have them: the licence that is found, whatever else is in the table."""

import math

import pytest
from pyspark.sql import functions as F

from terracite.llm import licenses

GNU = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU {kind}General Public License as published by\nthe Free Software Foundation, either version {v} of the License, or\n(at your option) any later version."
MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:"
BSD = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:"

CASES = [
    # identifiers: exact, whether or not a notice knows them
    ("MIT", "// SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "# SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "/* SPDX-License-Identifier: GPL-3.0-or-later */"),
    ("GPL-2.0", "// SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-2.0", "// SPDX-License-Identifier: GPL-2.0+"),
    ("LGPL-2.1", "// SPDX-License-Identifier: LGPL-2.1"),
    ("LGPL-2.1", "// SPDX-License-Identifier: LGPL-2.1-or-later"),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0-only"),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("CC-BY-4.0", "SPDX-License-Identifier: CC-BY-4.0"),
    ("CC-BY-NC-4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0."),
    ("WTFPL", "SPDX-License-Identifier: WTFPL"),
    ("Vim", "spdx-license-identifier:Vim"),
    ("MIT OR Apache-2.0", "// SPDX-License-Identifier: (MIT OR Apache-2.0)"),
    ("GPL-2.0 WITH Linux-syscall-note", "/* SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note */"),
    # one-line headers
    ("MIT", "Licensed under the MIT license."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Copyright 2019 The Foo Authors. All rights reserved.\nUse of this source code is governed by a MIT license"),
    ("MIT", "# The MIT License (MIT)"),
    ("ISC", "Released under the ISC License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-1.1", "Licensed under the Apache License, Version 1.1."),
    ("AFL-2.0", "Licensed under the Academic Free License, Version 2.0."),
    ("AFL-3.0", "Licensed under the Academic Free License, Version 3.0."),
    ("EUPL-1.2", "Licensed under the European Union Public Licence, Version 1.2."),
    ("EUPL-1.1", "Licensed under the European Union Public Licence, Version 1.1."),
    ("EPL-2.0", "Licensed under the Eclipse Public License, Version 2.0."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("Zlib", "Released under the zlib License."),
    ("Artistic-2.0", "This software is distributed under the terms of the Artistic License 2.0."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-1.1", "Licensed under the Mozilla Public License, Version 1.1."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("MIT OR Apache-2.0", "Licensed under either of Apache License, Version 2.0 or MIT license at your option."),
    # blocks and files
    ("Apache-2.0", "# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n#\n#     http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", GNU.format(kind="", v=3)),
    ("GPL-2.0", GNU.format(kind="", v=2)),
    ("AGPL-3.0", GNU.format(kind="Affero ", v=3)),
    ("LGPL-3.0", GNU.format(kind="Lesser ", v=3)),
    ("LGPL-2.1", GNU.format(kind="Lesser ", v="2.1")),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE\n                       Version 3, 19 November 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n Copyright (C) 1989, 1991 Free Software Foundation, Inc."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 2.1, February 1999"),
    ("Apache-2.0", "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS"),
    ("MIT", "MIT-style file\n\nCopyright (c) 2020 A. Person\n\n" + MIT),
    ("BSD-3-Clause", "Copyright (c) 2015, Someone\nAll rights reserved.\n\n" + BSD),
    ("BSD-3-Clause", "Use in source and binary forms, with or without modification, is allowed provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("Proprietary", "Copyright 2019 The Foo Authors. All rights reserved."),
    # nothing is claimed
    (None, "Er kam mit.\nMit.\nDas war es mit der Zeit."),
    (None, "It is the public domain of words; the rights of all men."),
    (None, "The license of the driver was taken away in June 2007."),
    (None, "Licensed under the Quux Particular License, Version 7.0."),
    (None, "version 2.0\n3\n1."),
    (None, "The MIT campus is in Cambridge, and the Apache people live elsewhere."),
]


@pytest.mark.parametrize("others", [0, 300])
def test_headers_and_files(spark, others):
    rows = [(k, f"some code before\n{text}\n\nand some after it" if text.count("\n") < 2 else text, f"d{k}/a.txt") for k, (_, text) in enumerate(CASES)]
    rows += [(1000 + i, "License license version 2.0 the Apache of MIT words" if i % 3 else "plain words of some file", f"e{i}/b.txt") for i in range(others)]
    got = {r["doc_id"]: r["licence"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, path string")).collect()}
    wrong = [(want, got[k], text) for k, (want, text) in enumerate(CASES) if got[k] != want]
    assert not wrong, wrong


def test_identifiers_stand_before_notices_and_weak_ones_behind(spark):
    text = "Licensed under the Apache License, Version 2.0.\nAll rights reserved.\nSPDX-License-Identifier: EUPL-1.2"
    rows = [(1, text, "a/LICENSE"), (2, "nothing here", "a/b/c.txt"), (3, None, "a/d.txt"), (4, "", None), (5, "All rights reserved.\nReleased under the MIT License.", "b/x.txt")]
    got = {r["doc_id"]: (r["licence"], r["basis"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, path string")).collect()}
    assert got == {1: ("EUPL-1.2", "notice"), 2: ("EUPL-1.2", "inherited"), 3: ("EUPL-1.2", "inherited"), 4: (None, "none"), 5: ("MIT", "notice")}


def test_no_statement_without_a_key_reaches_the_least_cosine():
    """Dropping a notice's keys leaves less of its norm than any match needs."""
    for _, notice in licenses.NOTICES:
        words = licenses._words(notice)
        square = lambda t: (words.count(t) * licenses.weights()[t]) ** 2
        rest = sum(square(t) for t in set(words) - set(licenses.keys()))
        assert rest < licenses.LEAST**2 * sum(square(t) for t in set(words))


def test_near_copies_of_common_words_are_not_scored(spark):
    """Long paragraphs of words that notices share with any prose, each a little different, reach no notice; statements that a notice matches all stay."""
    prose = [f"{'the of and in is to this that for with any by free use or it on all ' * 20}{k} the of and to." for k in range(40)]
    prose += [f"{prose[k]} Licensed under the MIT License, version 2.0 of GNU software. {'the of and in to ' * k}" for k in range(40)]
    held = lambda texts: {r[0] for r in spark.createDataFrame([(t,) for t in texts], "text string").select(F.explode(licenses.reachable(F.col("text")))).collect()}
    assert not held(prose)
    said = [notice for _, notice in licenses.NOTICES] + [text for _, text in CASES if "\n" not in text]
    said += [" ".join(w for k, w in enumerate(text.split()) if k % 9 != n) for text in said for n in (2, 4)] + [f"{text} it of the foo" for text in said]

    def cosine(words: list[str], notice: list[str]) -> float:
        a, b = ({t: ws.count(t) * licenses.weights().get(t, licenses.OUTSIDE) for t in ws} for ws in (words, notice))
        norm = math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
        return sum(a[t] * b.get(t, 0) for t in a) / norm if norm else 0.0

    notices, marks = [licenses._words(notice) for _, notice in licenses.NOTICES], set(licenses.MARKS)
    ws = {text: licenses._words(text) for text in said}
    match = {text for text in said if any(set(ws[text]) & marks == set(n) & marks and round(cosine(ws[text], n), 6) >= licenses.LEAST for n in notices)}
    assert len(match) > 300 and match <= held(said)
