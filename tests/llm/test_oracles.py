import os
import random

import duckdb
import pytest

from kinweave.llm import registry, secrets

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = registry.queries()[name](spark, DATA).toPandas(), con.sql(registry.oracle_sql()[name]).df()
    rows = lambda f: sorted(map(tuple, f[sorted(f.columns)].astype(str).values.tolist()))
    assert len(got) and rows(got) == rows(want)


def test_secrets_of_every_kind_in_sql():
    rnd = random.Random(13)
    letters = lambda n, more="": "".join(rnd.choice("ABCDEFGHIJabcdefghij0123456789" + more) for _ in range(n))
    key = "\n".join(letters(64, "+/") for _ in range(6))
    made = [
        f"ghp_{letters(36)}", f"github_pat_{letters(30, '_')}", f"xoxb-{letters(20, '-')}", f"AIza{letters(35, '_-')}", f"eyJ{letters(20)}.eyJ{letters(20)}.{letters(20)}", f"glpat-{letters(20, '-_')}", f"sk_live_{letters(24)}", f"rk_test_{letters(16)}",
        f"npm_{letters(36)}", f"pypi-{letters(60, '-_')}", f"SG.{letters(22, '-_')}.{letters(43, '-_')}", f"hf_{letters(34)}", f"AKIA{'Q7' * 8}", "0f" * 16, "Api_Key = 'abcdef-123'", "PASSWORD:x", "token=abc", f"-----BEGIN EC PRIVATE KEY-----\n{key}\n-----END EC PRIVATE KEY-----", f"-----BEGIN PRIVATE KEY-----\n{key}",
    ]
    texts = ["", None, *made, *(f"é {m} ſecret: {m}{m}\n日本 {m}" for m in made)] + [" é".join(rnd.sample(made, 8)) for _ in range(60)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    want = {r[0]: r[5] for r in con.sql(secrets.ORACLE_SQL).fetchall()}
    rules, raw = secrets.BASE + secrets.ADDED, [(t or "").encode() for t in texts]
    seen = set()
    for i, (data, spans) in enumerate(zip(raw, secrets.scanner_of(rules).spans(raw), strict=True)):
        assert ",".join(f"{rules[k].kind}:{len(data[:a].decode())}:{len(data[:b].decode())}" for k, a, b in spans) == want[i], texts[i]
        seen |= {rules[k].kind for k, *_ in spans}
    assert seen == {r.kind for r in rules}
