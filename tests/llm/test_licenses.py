from pathlib import Path

from compare import compare, oracle_connection
from conftest_data import SMALL
from kickpool.llm import licenses
from kickpool.llm.queries import ORACLES, QUERIES


def found(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = licenses.scan(docs, licenses.known_licenses(spark)).orderBy("doc_id").collect()
    return [(r.license, r.notices) for r in rows]


def test_against_sql(spark):
    assert compare(QUERIES["op4_licenses"](spark, SMALL), oracle_connection(SMALL), ORACLES["op4_licenses"]) == ""


def test_equivalent_spellings(spark):
    mit = licenses.TEXTS["MIT"]
    got = found(
        spark,
        mit,
        mit.upper().replace("[YEAR] [FULLNAME]", "1999-2020 Somebody Else, Inc."),
        "  licenced under THE apache licence version 2.0  ",
        "A text.\n\n" + mit + "\n\nMore text.",
        "First line.\nReleased under the MIT License\nLicensed under CC BY-NC 4.0.",
        "It says: Released under the MIT License, but within a sentence.",
        "Licensed under the Banana License.",
    )
    assert got[0] == ("MIT", "") and got[1] == ("MIT", "")
    assert got[2] == ("Apache-2.0", "Apache-2.0")
    assert got[3][0] is None or got[3] == (None, "MIT")
    assert got[4] == (None, "CC-BY-NC-4.0,MIT")
    assert got[5] == (None, "") and got[6] == (None, "")


def test_every_known_text_has_a_stem_and_one_licence():
    for name, text in licenses.known_rows():
        assert any(stem in text.lower() for stem in licenses.FULL_STEMS), (name, text)


def test_odd_rows(spark, odd_docs, no_docs):
    known = licenses.known_licenses(spark)
    rows = licenses.scan(odd_docs, known).collect()
    assert len(rows) == 8 and all((r.license, r.notices, r.n_notices) == (None, "", 0) for r in rows)
    assert licenses.scan(no_docs, known).count() == 0
    none = spark.createDataFrame([], "license string, text string")
    assert licenses.scan(odd_docs, none).where("n_notices > 0").count() == 0


def test_every_bsd_text(spark):
    rows = licenses.bsd_rows()
    got = found(spark, *(text.replace("[year] [fullname]", "2020, A. Body").replace("\n", "\r\n") for _, text in rows))
    assert [licence for licence, _ in got] == [name for name, _ in rows]
    assert all(any(s in text.lower() for s in licenses.FULL_STEMS) for _, text in rows)


def test_entire_longer_licences(spark):
    """Texts as a Debian system holds them; the table itself needs only their digests."""
    from pathlib import Path

    import pytest

    folder = Path("/usr/share/common-licenses")
    files = {"Apache-2.0": "Apache-2.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0"}
    if not all((folder / f).exists() for f in files.values()):
        pytest.skip("no licence texts here")
    texts = [(folder / f).read_text() for f in files.values()]
    got = found(spark, *texts, *(" ".join(t.upper().split(" ")) for t in texts), *(t + "\nand more" for t in texts))
    assert [licence for licence, _ in got] == [*files, *files, *[None] * len(files)]


def wrapped(text, width):
    """Prose paragraphs wrapped anew; blocks with indented or short lines stay as they lie."""
    import textwrap

    out = []
    for block in text.split("\n\n"):
        lines = block.strip("\n").split("\n")
        prose = len(lines) > 1 and min(map(len, lines[:-1])) > 48 and not any(line.startswith("    ") for line in lines)
        out.append(textwrap.fill(" ".join(block.split()), width, break_long_words=False, break_on_hyphens=False) if prose else block)
    return "\n\n".join(out)


def test_every_known_text_at_every_width(spark):
    texts = [(name, text) for name, text in licenses.known_rows() if "\n" in text]
    folder = Path("/usr/share/common-licenses")
    if folder.exists():
        names = {"GPL-1.0": "GPL-1", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.0": "LGPL-2", "LGPL-3.0": "LGPL-3"}
        texts += [(k, (folder / names.get(k, k)).read_text()) for k in licenses.FULL_DIGESTS if (folder / names.get(k, k)).exists()]
    widths = [*range(40, 121, 8), 53, 71, 79]
    got = found(spark, *(wrapped(text, width) for _, text in texts for width in widths))
    assert [licence for licence, _ in got] == [name for name, _ in texts for _ in widths]


def test_lines_that_begin_with_copyright_within_a_sentence(spark):
    mit, bsd = licenses.TEXTS["MIT"], next(t for n, t in licenses.bsd_rows() if n == "BSD-3-Clause")
    texts = [
        mit.replace("AUTHORS OR COPYRIGHT", "AUTHORS OR\nCOPYRIGHT"),
        bsd.replace("the above copyright notice", "the above\ncopyright notice"),
        mit.replace("Copyright (c) [year] [fullname]", "Copyright Somebody Else, Inc. and others"),
        mit.replace("Copyright (c) [year] [fullname]", "Copyright (c) 2001-2020, A\nCopyright 2021 B\n© C\n(c) 2022 D"),
        mit.replace("Copyright (c) [year] [fullname]", "Copyright by the authors\r\n * (C) 1999 E"),
    ]
    assert [licence for licence, _ in found(spark, *texts)] == ["MIT", "BSD-3-Clause", "MIT", "MIT", "MIT"]


def test_sql_knows_the_same_texts(spark, tmp_path):
    import duckdb

    texts = [t for _, t in licenses.known_rows()][::7] + ["no licence", None, "", "Released under the MIT License\nand more"]
    folder = Path("/usr/share/common-licenses")
    texts += [(folder / f).read_text() for f in ("Apache-2.0", "GPL-2", "MPL-2.0") if (folder / f).exists()]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    docs.coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    assert compare(licenses.scan(docs, licenses.known_licenses(spark)), con, licenses.scan_sql()) == ""
