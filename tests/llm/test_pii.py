import hashlib
import random
import re

import duckdb

from tapespark.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base(text):
    out = []
    for kind, p in BASE.items():
        for m in re.finditer(p, text, re.A):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def texts():
    rnd = random.Random(7)
    parts = ["a@b.c", "x@y.com_z@w.org", "é1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.1.1", "007.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (017) 555-7713", "+12", "+1234567890123456", "call 555-123-4567", "555-123-4567", "iban GB82WEST12345698765432", "GB82WEST12345698765433", "GB82 WEST 1234 5698 7654 32", "account", "PHONE:", "mail", "😀", "ü@x.de", "..@a-b.c.", "@", "+", "12", " ", "\n", "--"]
    out = ["".join(rnd.choice(parts) + rnd.choice(["", " ", ", "]) for _ in range(rnd.randint(0, 12))) for _ in range(300)]
    return [*out, None, "", "1." * 30000, "a" * 50000 + "@", "1 " * 30000, "+1" + " " * 5000, "q@a.b " * 700]


def test_base_spans_against_python(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("base", pii.F.lit(1))
    for r in pii.scan(df).collect():
        want = base(rows[r["doc_id"]][1] or "")
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), rows[r["doc_id"]][1][:200]
        for k in BASE:
            assert r[f"n_{k}"] == sum(x.startswith(k) for x in want)
        assert [x for x in r["spans"].split(",") if x and x.split(":")[0] in BASE] == want


def test_added_kinds(spark):
    rows = [
        (1, "IBAN GB82WEST12345698765432 and GB82WEST12345698765433"),
        (2, "call 555-123-4567 or, " + "much later in this long sentence, " * 2 + "555-123-4567"),
        (3, "please phone: 555 123 4567"),
        (4, "1555-123-45678 phone XGB82WEST12345698765432"),
        (5, "pay to ES91 2100 0418 4502 0005 1332 Please, or DE89 3704 0044 0532 0130 00"),
        (6, "555.123.4567 is the telephone, as is 555.123.4568"),
        (7, "mail a.b@c.de, 555-123-4567"),
    ]
    got = {r["doc_id"]: (r["spans"], r["scores"]) for r in pii.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {
        1: ("iban:5:27", "95"),
        2: ("local_phone:5:17", "55"),
        3: ("local_phone:14:26", "55"),
        4: ("", ""),
        5: ("iban:7:36,iban:48:75", "60,60"),
        6: ("local_phone:0:12,local_phone:37:49", "55,55"),
        7: ("email:5:13", "125"),
    }


def test_names_that_clash(spark):
    df = spark.createDataFrame([("a@b.co", 1, 2, 3)], "text string, x int, y int, z int").toDF("text", "__base", "a.b", "email")
    (r,) = pii.find_pii(df, df.columns).collect()
    assert r.__fields__ == [*df.columns, "__base_", "__found"] and (r["__base"], r["a.b"], r["email"], len(r["__base_"])) == (1, 2, 3, 1)


def test_sql_gives_the_same(spark, tmp_path):
    rows = [x for x in enumerate(texts()) if x[1] is None or len(x[1]) < 3000]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    path = str(tmp_path / "documents.parquet")
    df.write.parquet(path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    names = [c for c in pii.scan(df).columns]
    want = sorted(con.sql(f"SELECT {', '.join(names)} FROM ({pii.ORACLE_SQL})").fetchall())
    assert sorted(tuple(r) for r in pii.scan(spark.read.parquet(path)).collect()) == want
    assert pii.scan(df.limit(0)).collect() == []
