"""Token counts, decontamination, substring dedup and HTML text against brute-force versions."""

import hashlib
import re

import pytest

from lateline.llm import decontamination, html_text, substring_dedup, token_counts

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, start string, owner string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)


# ---- token counts

def test_token_counts_equal_the_tokenizer(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers
    vocabulary = token_counts.load_vocabulary(MODEL)
    low = min(s for _, s in vocabulary)
    bytes_ = [(f"<0x{b:02X}>", low) for b in range(256)]
    tokenizer = Tokenizer(models.Unigram([("<unk>", low), *vocabulary, *bytes_], 0, True))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace("▁", "always", True)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    rows += [(-1, "  a  b "), (-2, ""), (-3, "▁x"), (-4, "漢字🙂\n\nfoo"), (-5, "ab" * 30_000)]
    got = token_counts.token_counts(frame(spark, [*rows, (None, None)]), vocabulary).collect()
    want = [(i, len(tokenizer.encode(t, add_special_tokens=False).ids)) for i, t in rows]
    assert sorted(map(tuple, got), key=str) == sorted([*want, (None, 0)], key=str)


@pytest.mark.parametrize("fallback", [True, False])
def test_ties_go_to_the_earliest_start(fallback):
    from tokenizers import Tokenizer, models
    vocabulary = [("a", -1.0), ("b", -1.0), ("aa", -2.0), ("ab", -2.0), ("ba", -2.0), ("▁", -1.0)]
    counter = token_counts.Counter(vocabulary, fallback)
    bytes_ = [(f"<0x{b:02X}>", -2.0) for b in range(256)] if fallback else []
    tokenizer = Tokenizer(models.Unigram([("?", -2.0), *vocabulary, *bytes_], 0, fallback))
    for text in ("aab", "abaab", "ba", "xyab", "axyb", "bbaaé", "é"):
        assert counter.word("▁" + text) == len(tokenizer.encode("▁" + text).ids), text


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert token_counts.token_counts(empty, token_counts.load_vocabulary(MODEL)).count() == 0
    assert substring_dedup.dedup_substrings(empty).count() == 0
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.find_leaks(empty, items).count() == 0
    assert decontamination.find_leaks(frame(spark, [(1, "a b c"), (2, None)]), items).count() == 0


# ---- decontamination

def brute_leaks(docs, items):
    out = {}
    for doc_id, text in docs:
        words = decontamination.words_of(text)
        for item_id, (item,) in items.items():
            steps = -(-len(item.words) // 8) * 8
            for at in range(0, max(1, len(words) - steps), 4):
                share = decontamination.judge(item, words[at:at + 2 * steps])
                if share:
                    out[doc_id, item_id] = max(share, out.get((doc_id, item_id), 0))
    return out


def test_leaks_match_brute_force(spark):
    items = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    texts = {r.item_id: r.text for r in items.collect()}
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    words = texts[3].split()
    docs += [(-1, "x y z " * 50 + texts[3] + " q" * 70), (-2, " ".join(words[:-2])), (-3, ""),
             (None, None), (-4, " ".join(w for k, w in enumerate(words) if k % 8 != 3))]
    got = decontamination.find_leaks(frame(spark, docs), items).collect()
    single = {i: list(*zip(*[v[0] for v in decontamination.build_index(
        [(i, t)], *_flat()).classes.values()])) for i, t in texts.items()}
    want = brute_leaks(docs, {i: x for i, x in single.items()})
    found = {(r.doc_id, r.item_id) for r in got}
    assert {(-1, 3), (-2, 3), (-4, 3)} <= found
    assert len(found & set(want)) >= 0.9 * len(want)
    kept = {r.doc_id for r in decontamination.drop_contaminated(frame(spark, docs), items).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _ in found}


def _flat():
    import numpy as np
    return np.ones(decontamination.FEATURES), np.ones((decontamination.FEATURES, 1))


def test_lcs():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = row[:]
            for k, y in enumerate(b):
                row[k + 1] = before[k] + 1 if x == y else max(before[k + 1], row[k])
        return row[-1]
    for a, b in (("abcde", "xaybzc"), ("aaa", "aa"), ("", "a"), ("abab" * 20, "baba" * 30)):
        assert decontamination.lcs(list(a), list(b)) == plain(a, b)


# ---- substring dedup

def brute_dedup(rows):
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(words)
        for k in range(len(words) - 19):
            window = tuple(words[k:k + 20])
            if window in seen:
                gone[k:k + 20] = [True] * 20
            seen.add(window)
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out[doc_id] = (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("hot", [0, 3, 2000])
def test_substrings_match_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup.repeated_windows, "__defaults__", (50, hot))
    line = " ".join(f"w{k}" for k in range(30))
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    rows += [(10_000 + k, f"head{k} {line} tail{k}") for k in range(12)]
    rows += [(20_000, "same " * 45), (20_001, None), (20_002, ""), (20_003, line), (None, line),
             (20_004, " ".join(f"w{k}" for k in range(19))), (20_005, line + "\t" + line)]
    got = substring_dedup.dedup_substrings(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute_dedup(rows)
    assert len(got) == len(rows)


@pytest.mark.parametrize("hot", [3, 2000])
def test_a_passage_with_repeated_windows_is_one_row(spark, hot):
    """However often it comes and however many of its windows start earlier."""
    line = " ".join(f"w{k}" for k in range(32))
    keyed = substring_dedup._keyed(frame(spark, [(k, f"head{k} {line} tail{k}") for k in range(40)]))
    found = substring_dedup.passages(keyed, substring_dedup.distinct_texts(keyed))
    spans = substring_dedup.repeated_windows(found, 50, hot).collect()
    assert len(spans) <= found.count()
    starts = {(r.rid, s // 64 + k) for r in spans for s in r.spans for k in range(s % 64)}
    assert len(starts) == 39 * 13 and {s for _, s in starts} == set(range(1, 14))


def test_large_ids_beside_a_null_id_keep_their_order(spark):
    rows = [(None, " ".join(f"v{p}x{k}" for p in range(8) for k in range(25)))]
    for p in range(8):
        line = " ".join(f"w{p}x{k}" for k in range(25))
        rows += [(2**60 + 2 * p + k, f"head{p}x{k} {rows[0][1][:300]} {line}") for k in (1, 0)]
    got = substring_dedup.dedup_substrings(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute_dedup(rows)


# ---- HTML

@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("plain &amp; text", "plain & text"),
    ("<p>a<p>b", "a\n\nb"), ("a<br>b", "a\nb"), ("<div>a</div><div>b</div>", "a\nb"),
    ("<ul><li>a<li>b</ul>", "- a\n- b"), ("<ol start=3><li>a<li>b</ol>", "3. a\n4. b"),
    ("<ul><li>a<ul><li>b</ul><li>c</ul>", "- a\n  - b\n- c"),
    ("<table><tr><td>aa<td>b<tr><td>c<td>dd</table>", "aa  b\nc   dd"),
    ("<script>x='</p>'</script>y<style>p{}</style>", "y"), ("a<!-- b -->c", "ac"),
    ("<p hidden>a</p>b<i style='display: none'>c</i>", "b"), ("<pre>a\n  b</pre>", "a\n  b"),
    ("x <b> y </b>z", "x y z"), ("1 < 2 <", "1 < 2 <"), ("a<p", "a"), ("</b>a</div>", "a"),
    ("<head><title>t</title></head><body>a", "a"), ("<img alt='cat'>", "cat"),
    ("a < b <3", "a < b <3"),
])
def test_html(page, text):
    assert html_text.extract(page) == text


def test_html_of_any_depth_and_size(spark):
    deep = "<div>" * 50_000 + "a" + "</div>" * 50_000 + "<p>b " * 20_000
    rows = [(1, "u", deep), (1, "u", "<b>x"), (None, None, None)]
    got = html_text.visible_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    texts = {r.text[:3] for r in got.collect()}
    assert texts == {"a\n\n", "x", ""}
