"""Small documents with every awkward case."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from plain import prose  # noqa: E402

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id int, family string, kept string, row int, n_words string, _rule_kept int"


def awkward() -> list[tuple[int | None, str | None]]:
    base = prose(1, 120)
    near = base.replace(base.split()[60], "changed", 1)
    passage = prose(2, 30)
    rows = [(i, prose(100 + i, 40 + i)) for i in range(10, 30)]
    rows += [(3, base), (5, base.upper()), (4, near), (7, f"{prose(8, 50)} {passage} {prose(9, 20)}"), (2, f"{prose(10, 40)} {passage}")]
    rows += [(40, ""), (41, None), (42, " \n\t "), (43, "one"), (44, "one"), (45, "a b c"), (46, "A b  c"), (47, "x " * 500), (48, "l\nl\nl\nl")]
    rows += [(49, "naïve   café 漢字 \U0001f600 \x1c end"), (50, prose(11, 20000, 4000)), (51, base + " " + base), (52, "y" * 3000)]
    rows += [(None, base), (None, None), (3, base), (10, rows[0][1]), (10, "another text of ten that differs from it in all its words")]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, t, ["en", "de", None][k % 3], ["a", "b", None, "c"][k % 4], None, k, "f", "x", 1, "n", 2) for k, (i, t) in enumerate(awkward())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
