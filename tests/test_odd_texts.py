"""Queries over texts whose letters, edges of words and white space Java and SQL read in other ways, against their SQL."""

from __future__ import annotations

import duckdb
import pytest
from test_queries import rows

from lumenpress.plans.catalog import ORACLE, QUERIES

TEXTS = [
    None,
    "",
    "öle 12.03 geldi. Le 12.03 bon. élé der 1/2! ñthe 3-4. the\x0b 5.6",
    "bir.\x0bdie 7.8 der? le",
    # three reports of one title
    *("Ortak başlık\n" + t for t in ("Ççeau Ççeau geldi. Fiyat 5 MILYON oldu. Şirket KAZANDI. Şirket kazandı. oléé Été Ete geldi", "Şirket kazandı. xÇa Çb gitti. Fiyat 5 milyon oldu. 3 MAYIS günü. 3 mayıs günü. é2020 yılı", "Ali Veli geldi. Re oié Oié\x0bOié geldi. " + "Uzun Cümle\x0bAli " * 15 + "bitti. 2020é yılı")),
]


@pytest.fixture(scope="module")
def texts(tmp_path_factory):
    d = str(tmp_path_factory.mktemp("odd"))
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    c.executemany("INSERT INTO documents VALUES (?, ?, 'fr', 'src1', ?)", [(k, t, len(t or "")) for k, t in enumerate(TEXTS)])
    c.execute(f"COPY documents TO '{d}/documents.parquet' (FORMAT parquet)")
    return d, c


@pytest.mark.parametrize("name", ["c29_dated_sentences", "d19_claim_holders"])
def test_odd_texts_as_in_sql(spark, texts, name):
    d, c = texts
    want = rows(c.execute(ORACLE[name]).fetchdf())
    assert rows(QUERIES[name](spark, d).toPandas()) == want
    assert len(want) > 5
