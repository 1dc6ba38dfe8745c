"""PII, SimHash, exact dedup, URL filter and toxicity against brute-force versions."""

import hashlib
import re
import zlib

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from lateline.llm import exact_dedup, pii, queries, simhash, toxicity, url_filter

SF_DIR = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"
LARGEST = "/root/testdata/sf0.1"
SCHEMA = "doc_id long, text string, start string, owner string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)


def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]


# ---- personal data

GIVEN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
         "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
         "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_luhn(digits):
    return sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def brute_base(text):
    out = []
    for kind, regex in GIVEN.items():
        for m in re.finditer(regex, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split("."))
                    if kind == "ip" else None,
                    "card": 16 <= len(digits) <= 19 and brute_luhn(digits),
                    "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


ODD = ["", None, " ", "a@b.c_d@e.f", "a@b..c", "a@b.c.d@e.f", "1.2.3.4.5.6.7.8", "256.1.1.1 01.002.3.255",
       "4111 1111 1111 1111", "4111-1111-1111-1111-", "x4111111111111111 4111111111111112",
       "+1 (800) 555-0199 x", "+12 3", "+1+1 234 567 89", "🙂 é a@b.co 🙂 +44 20 7946 0958.",
       "token=abcdefgh12345678", "a at b dot com", "(555) 123-4567", "1" * 40_000, "a." * 20_000,
       "a@" + "b." * 5_000 + "c", "+1" + "(" * 20_000, "x@y.z " * 2_000, "1 2 3 " * 5_000,
       "4111 1111 1111 1111 +1 800 555 0199", "12.3.4.5.6", "mail: joe [at] site [dot] org"]


def test_pii_base_spans_equal_the_given_patterns(spark):
    rows = documents(spark) + [(-1 - k, t) for k, t in enumerate(ODD)] + [(None, "a@b.co"), (-1, "")]
    got = queries.op9(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    want = {}
    for doc_id, text in rows:
        spans = brute_base(text)
        kinds = [k for k, *_ in spans]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        want[doc_id] = (*[kinds.count(k) for k in GIVEN], hashlib.sha256(joined.encode()).hexdigest(),
                        spans)
    for r in got:
        assert tuple(r)[1:6] == want[r.doc_id][:5], (r.doc_id, r, want[r.doc_id])
        all_spans = r.spans.split(",") if r.spans else []
        assert {f"{k}:{a}:{b}" for k, a, b in want[r.doc_id][5]} <= set(all_spans)
    assert queries.op9(frame(spark, [])).count() == 0


def test_trees_learn_and_redaction(spark):
    counts = {c: (100, 95 if c & 1 else 5) for c in range(8)}
    trees = pii.fit_trees(counts)
    assert pii.score_of(trees, 1) > 0.9 > 0.1 > pii.score_of(trees, 2)
    df = spark.createDataFrame([("ab cd ef", [(0, 3, 5), (1, 4, 7)])],
                               "text string, spans array<struct<k:int,start:int,end:int>>")
    assert df.select(pii.redact(F.col("text"), F.col("spans"), "#").alias("x")).first().x == "ab #f"


# ---- SimHash

def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    size = min(3, len(words))
    grams = [" ".join(words[k:k + size]) for k in range(len(words) - size + 1)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """Smallest id reachable of each row; prints: (id, fingerprint)."""
    label = {fp: min(i for i, f in prints if f == fp) for _, fp in prints}
    while True:
        new = {a: min(label[b] for b in label if (a ^ b).bit_count() <= 2) for a in label}
        if new == label:
            return label
        label = new


@pytest.mark.parametrize("dense", [simhash.DENSE, 1])
def test_simhash_equals_brute_force(spark, dense):
    rows = documents(spark)
    base = max((t for _, t in rows), key=lambda t: len(t or ""))
    rows += [(10_000 + k, base + f" tail{k}") for k in range(6)]
    rows += [(11_000, None), (11_001, ""), (11_002, " \t"), (11_003, "One"), (11_004, "one TWO"),
             (11_005, "É É é"), (11_006, "a b c " * 1_000), (11_007, "a b c " * 1_000)]
    got = simhash.near_dedup(frame(spark, rows), dense).collect()
    prints = [(i, brute_print(t)) for i, t in rows]
    label = brute_components(prints)
    assert sorted(map(tuple, got)) == sorted((i, f"{fp:016x}", label[fp]) for i, fp in prints)
    assert len({label[fp] for i, fp in prints if 10_000 <= i < 10_006}) == 1
    kept = simhash.keep_one_per_group(frame(spark, rows))
    assert kept.count() == len(set(label.values())) and kept.columns == frame(spark, rows).columns


@pytest.mark.parametrize("dense", [simhash.DENSE, 3])
def test_links_join_all_close_values(spark, dense):
    import random
    rng = random.Random(3)
    values = {rng.getrandbits(64) for _ in range(40)}
    for v in list(values):
        for _ in range(6):
            v ^= 1 << rng.randrange(64)
            values.add(v ^ (1 << rng.randrange(64) if rng.random() < .5 else 0))
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    prints = spark.createDataFrame(signed, "fp long")
    found = {r.node: r.label for r in simhash.components(simhash.links(prints, dense)).collect()}
    label = brute_components([(v, v % 2**64) for v, in signed])
    for a, in signed:
        for b, in signed:
            same = label[a % 2**64] == label[b % 2**64]
            assert (found.get(a, a) == found.get(b, b)) == same


def test_simhash_of_few_rows(spark):
    assert simhash.near_dedup(frame(spark, [])).count() == 0
    got = simhash.near_dedup(frame(spark, [(None, "a"), (4, "a"), (4, "a")])).collect()
    assert sorted(str(r.doc_id) for r in got) == ["4", "4", "None"]
    assert {r.component_id for r in got} == {4}


# ---- exact dedup

def test_exact_dedup_edges(spark):
    rows = documents(spark) + [(-1, None), (-2, ""), (None, "only"), (-3, "x"), (-3, "x"),
                               (-4, "a" * 500_000), (-5, "a" * 500_000), (-6, "A" * 10)]
    got = queries.op8(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    groups = {}
    for i, t in rows:
        groups.setdefault(hashlib.sha256((t or "").encode()).hexdigest(), []).append(i)
    for r in got:
        ids = groups[r.text_sha256]
        assert r.keep_id == max(ids, key=lambda i: (i is not None, i)) and r.group_size == len(ids)
    assert sum(r.kept for r in got) == len(groups)
    assert exact_dedup.keep_first_of_equal(frame(spark, rows)).count() == len(groups)
    assert queries.op8(frame(spark, [])).count() == 0


def test_exact_dedup_against_history(spark):
    docs = frame(spark, [(1, "a"), (2, "b"), (3, "b"), (4, "c")])
    history = frame(spark, [(100, "a"), (101, "a")])
    got = {r.doc_id: (r.keep_id, r.kept) for r in
           exact_dedup.exact_dedup(docs, history).collect()}
    assert got == {1: (101, False), 2: (3, False), 3: (3, True), 4: (4, True)}


# ---- urls

def brute_url(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [h + p for h, p, _ in url_filter.RULES
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=len, default=None)


def test_urls_equal_brute_force(spark):
    urls = [r.url for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()]
    urls += [None, "", "x", "://", "http://EXAMPLE.org/en/12", "http://org/", "http://org", "http://a.b.com/de/x?y",
             "http://xcom/fr/", "http://notexample.org/es/", "https://a.example.org/es/#f", "u://com/fr/",
             "http://h.net/cheap-pills/1", "http://h.net/xcheap-pills", "http://h.net/free-x-y-download",
             "http://a.com?x://b.org/", "http://example.org:80/es/", "http://a.com/fr", "http://é.com/DE/"]
    pages = spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(urls)],
                                  "page_id long, url string, token string, verdict string")
    got = {r.page_id: r for r in url_filter.filter_urls(pages).collect()}
    verdicts = {h + p: v for h, p, v in url_filter.RULES}
    assert len(got) == len(urls)
    for k, u in enumerate(urls):
        host, path, rule = brute_url(u)
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule), u
        if rule:
            assert got[k].verdict == verdicts[rule]
    of = {u: got[k].verdict for k, u in enumerate(urls)}
    assert of["http://h.net/cheap-pills/1"] == of["http://h.net/free-x-y-download"] == "block"
    assert of["http://h.net/xcheap-pills"] == of[None] == "allow"
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    want = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, SF_DIR)
    assert sorted(got.columns) == sorted(columns)
    key = lambda row: str(row)
    rows = sorted((tuple(r) for r in got.select(*columns).collect()), key=key)
    assert rows == sorted(want.fetchall(), key=key)


# ---- toxicity

@pytest.mark.parametrize("sf_dir", [LARGEST])
def test_toxicity_on_held_out_documents(spark, sf_dir):
    """Not at a tenth of the size: 6 held-out toxic documents there say nothing of a ranking."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity(docs, labels)
    rows = got.join(labels, "doc_id").filter("held_out").collect()
    assert got.count() == docs.count()
    toxic = [r.score for r in rows if r.toxic]
    clean = [r.score for r in rows if not r.toxic]
    wins = sum((a > b) + (a == b) / 2 for a in toxic for b in clean) / (len(toxic) * len(clean))
    right = sum(r.predicted == r.toxic for r in rows) / len(rows)
    print("toxicity", len(toxic), len(clean), wins, right)
    assert wins > 0.95 and right > 0.95


def test_toxicity_folds_and_edges(spark):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    docs = documents(spark)
    rows = docs + [(-1, None), (-2, ""), (-3, "  "), (None, "x"), (-4, "word " * 50_000)]
    got = toxicity.toxicity(frame(spark, rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    for r in got:
        assert r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0)
    by_id = {r.doc_id: r.score for r in got}
    assert by_id[-1] == by_id[-2] == by_id[-3]
    assert toxicity.toxicity(frame(spark, []), labels).count() == 0
    assert toxicity.toxicity(frame(spark, docs[:3]), labels.limit(0)).count() == 3
