"""The queries with SQL against DuckDB: on the smallest tables, and on small ones made for the operators' edges."""

import duckdb
import pytest

from zedweave.llm import licences
from zedweave.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
WORDS = lambda i, n: " ".join(f"w{i}y{j}" for j in range(n))


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    menu = ["home news shop search", "about us and you", "Terms  of use and more", "contact us by mail", "all rights reserved by us", "follow us on every network now"]
    texts = [(i, "\n".join([f"own{i} line{i}", *menu]), "h") for i in range(25)] + [(100 + i, "\n".join([WORDS(i, 30), *menu[:2]]), "h") for i in range(5)]
    texts += [(150 + i, "\n".join([WORDS(i, 30), *menu]), None) for i in range(21)]
    notices = [t for _, t, _ in licences.TEMPLATES]
    texts += [(200, "\n\n".join(t.capitalize() for t in notices), "a"), (201, None, None), (202, "", "a"), (203, " \n\t\n", "a"), (204, "THIS wor\u212a is LICENSED under the GNU General Public License version 3", "a"),
              (205, "MIT License; mit-license. Apache\nLicense " + "general public license " * 3, "b"), (206, "mit", None), (207, "a b c d e f g h " * 9 + "i", "b"), (208, WORDS(9, 40) + "\nx\ny x\nx", "b")]
    texts += [(300 + i, f"see below {t} end", "n") for i, t in enumerate(notices)] + [(400 + i, f"{t[: len(t) // 2]} and {t[len(t) // 3 :]}", "n") for i, t in enumerate(notices)]
    pages = [(1, "u", "<p>"), (2, None, "<p>"), (3, "u", None), (4, "u", ""), (5, "u", "<b>" * 1000), (6, "u", "\u00e9\U0001f600"), (9, "u", "<p>")]
    place = tmp_path_factory.mktemp("sql")
    spark.createDataFrame(texts, "doc_id long, text string, source string").write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{place}/pages.parquet")
    return str(place)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, small, name):
    for folder in (SF, small):
        con = duckdb.connect()
        for t in ("documents", "pages"):
            one = f"{folder}/{t}.parquet" + ("/*.parquet" if folder == small else "")
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{one}')")
        df = QUERIES[name](spark, folder)
        r = con.execute(ORACLE_SQL[name])
        names = [d[0] for d in r.description]
        assert sorted(names) == sorted(df.columns)
        assert sorted(map(tuple, df.select(*names).collect()), key=str) == sorted(r.fetchall(), key=str)
