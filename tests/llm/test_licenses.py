from pathlib import Path

import pytest

from stratafold.llm import licenses

MIT = licenses.KNOWN[0][1]


@pytest.mark.parametrize("known", [10**5, 0])
def test_scan(spark, monkeypatch, known):
    monkeypatch.setattr(licenses, "MAX_BROADCAST_KNOWN", known)
    rows = [
        (1, MIT), (2, "Copyright (c) 2001-2024 Someone\n\n" + MIT.upper()), (3, MIT.replace("license", "licence").replace(" ", "\n  ")), (4, MIT + " And more."),
        (5, "Some prose here.\n  RELEASED under the MIT licence!\nmore\nReleased under the MIT License."), (6, "x Released under the MIT License."), (7, None), (8, ""), (9, " \n--"),
        (10, "© 2020 A\nLicensed under CC BY-NC 4.0"), (11, "SPDX-License-Identifier: Apache-2.0"), (12, "a\n" * 200_000), (13, "w " * 300_000), (1, MIT), (1, "Licensed under CC BY 4.0"),
        (None, "ISC License\nCopyright 1999 by X\n" + licenses._ISC.replace("AUTHOR", "author")), (14, licenses._BSD_2 + licenses._BSD_3.replace("holder", "owner") + licenses._BSD_END),
    ]
    got = licenses.scan(spark.createDataFrame([(a, b, "z") for a, b in rows], "doc_id long, text string, license string")).collect()
    named = sorted((str(r.doc_id), r.license, r.line_licenses, r.n_license_lines) for r in got)
    want = [
        ("1", "MIT", "", 0), ("2", "MIT", "", 0), ("3", "MIT", "", 0), ("4", None, "", 0), ("5", None, "MIT", 2), ("6", None, "", 0), ("7", None, "", 0), ("8", None, "", 0), ("9", None, "", 0),
        ("10", "CC-BY-NC-4.0", "CC-BY-NC-4.0", 1), ("11", "Apache-2.0", "Apache-2.0", 1), ("12", None, "", 0), ("13", None, "", 0), ("1", "MIT", "", 0), ("1", "CC-BY-4.0", "CC-BY-4.0", 1),
        ("None", "ISC", "", 0), ("14", "BSD-3-Clause", "", 0),
    ]
    assert named == sorted(want, key=str) or sorted(named, key=str) == sorted(want, key=str)
    digests = {r.doc_id: r.digest for r in got if r.doc_id in (2, 3, 7, 8, 9)}
    assert digests[2] == digests[3] and digests[7] == digests[8] == digests[9]


def test_empty(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_full_texts_and_notices(spark):
    files = {x: (Path(licenses.__file__).parent / f"texts/{f}.txt").read_text() for x, f in licenses._FILES.items()}
    rows = [(x, t.replace("\n", "\r\n  ")) for x, t in files.items()]
    rows += [(x, t[: t.index(licenses._END)]) for x, t in files.items() if licenses._END in t]
    rows += [("Unlicense", licenses._UNLICENSE), ("BSL-1.0", "Copyright 2020 A\n" + licenses._BSL)]
    notice = "# " + licenses._APACHE_NOTICE.format("http").replace("\n", "\n# ")
    rows += [("Apache-2.0", "# Copyright 2020 A\n" + notice), ("AGPL-3.0-or-later", licenses._GNU_NOTICE.format("GNU Affero General Public License", "https"))]
    rows += [("None", files["MPL-2.0"] + " more"), ("None", files["GPL-3.0-only"][5000:])]
    got = licenses.scan(spark.createDataFrame(list(enumerate(t for _, t in rows)), "doc_id long, text string")).collect()
    assert [str(r.license) for r in sorted(got, key=lambda r: r.doc_id)] == [x for x, _ in rows]
    assert len(rows) == 20
