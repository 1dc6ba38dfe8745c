"""Spans that the PII method adds to the base patterns."""

import random

import pytest

from lateline.llm import pii, queries

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


def planted(rng):
    """Base spans, matches that fail their check, and candidates of the generators."""
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    out = []
    for _ in range(150):
        out += [f"you can call +1 ({n(3)}) {n(3)}-{n(4)} today", f"reach joe{n(3)}@site.org now",
                f"build +{n(1)} ({n(2)}) {n(1)}- done", f"release 999.{n(1)}.{n(1)}.{n(2)} is out",
                f"order {n(4)} {n(4)} {n(4)} was sent", f"host 10.0.{n(1)}.{n(1)} is up",
                f"token=abc{n(14)}xyz", "password: required", f"write to ann [at] site{n(2)} [dot] org"]
    return out


ADDED = {-1: ("ring (555) 123-4567 at noon", "phone", "(555) 123-4567"),
         -2: ("mail: joe [at] site [dot] org", "email", "joe [at] site [dot] org"),
         -3: ("token=abcdefgh12345678", "secret", "token=abcdefgh12345678"),
         -4: ("phone 555-123-4567, best", "phone", "555-123-4567")}


@pytest.mark.parametrize("with_documents", [False, True])
def test_unprefixed_phone_bracketed_address_and_labelled_secret_are_added(spark, with_documents):
    rows = list(enumerate(planted(random.Random(4))))
    if with_documents:
        rows += [(10_000 + r.doc_id, r.text)
                 for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    rows += [(k, text) for k, (text, *_) in ADDED.items()]
    rows += [(-9, "the password: required by all"), (-10, "order 1234 5678 9012 was sent")]
    got = {r.doc_id: r for r in queries.op9(spark.createDataFrame(rows, SCHEMA)).collect()}
    for k, (text, kind, span) in ADDED.items():
        start = text.index(span)
        assert f"{kind}:{start}:{start + len(span)}" in got[k].spans.split(","), (k, got[k].spans)
    assert "secret" not in got[-9].spans and "card" not in got[-10].spans


def test_fragments_of_base_phones_are_no_negatives():
    phone = pii.KINDS.index("phone") * pii.BITS
    good, bad, unseen = phone + 49, phone + 4, phone + 48
    codes = pii.accepted_codes({good: (100, 100), bad: (100, 0)}, {good: (20, 20), bad: (20, 0)},
                               [good, bad, unseen])
    assert good in codes and bad not in codes
    assert unseen in pii.accepted_codes({good: (100, 100)}, {good: (20, 20)}, [unseen])
