"""The whole pipeline against slow versions of its five stages, chained; only fitted verdicts and spans come from the operators."""

import collections
import zlib

import numpy as np
import pytest
from test_operators import FOLDER, slow_near

import corpus_pipeline
from docketlake.llm import pii, quality_rules
from docketlake.llm.common import table
from docketlake.llm.queries import tokenizer_path


def slow_exact(rows):
    """Of equal texts the largest id."""
    last = {}
    for i, t in rows:
        last[t or ""] = max(last.get(t or "", i), i)
    return [(i, t) for i, t in rows if last[t or ""] == i]


def slow_redaction(text, spans):
    """Spans that overlap become one, named by the first; each is replaced by its kind."""
    merged = []
    for start, end, kind in spans:
        if merged and merged[-1][1] > start:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end, kind])
    out, done = "", 0
    for start, end, kind in merged:
        out += text[done:start] + f"<{kind}>"
        done = end
    return out + text[done:]


def slow_pieces(rows, tokenizer):
    """Pieces with their ids' checksum, and how many sequences best-fit decreasing needs."""
    pieces, rests, whole = collections.Counter(), [], 0
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        for s in range(0, len(ids), 4096):
            part = ids[s:s + 4096]
            pieces[i, s, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
            if len(part) == 4096:
                whole += 1
            else:
                rests.append(len(part))
    free = []
    for n in sorted(rests, reverse=True):
        fits = [f for f in free if f >= n]
        if fits:
            free.remove(min(fits))
        free.append((min(fits) if fits else 4096) - n)
    return pieces, whole + len(free)


def test_pipeline_is_its_stages_in_turn(spark):
    from tokenizers import Tokenizer

    docs = table(spark, FOLDER, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    kept = {r["doc_id"] for r in quality_rules.quality_verdicts(docs, table(spark, FOLDER, "labels")).filter("kept").select("doc_id").collect()}
    rows = slow_exact([r for r in rows if r[0] in kept])
    rows = [(i, t) for (_, i), texts in slow_near(rows).items() for t in texts]
    left = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r["doc_id"]: [(int(s), int(e), k) for k, s, e in (x.split(":") for x in r["spans"].split(",") if x)] for r in pii.personal_data(left).collect()}
    rows = [(i, slow_redaction(t, spans[i])) for i, t in rows]
    assert any("<email>" in t for _, t in rows)
    pieces, sequences = slow_pieces(rows, Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")))
    found = corpus_pipeline.run(spark, FOLDER).toPandas()
    assert collections.Counter(zip(found.doc_id, found.start, found.length, found.ids_crc32, found.doc_tokens, strict=True)) == pieces
    assert found.sequence_id.nunique() == sequences
    for _, s in found.sort_values("offset").groupby("sequence_id"):
        assert (s.offset == s.length.cumsum() - s.length).all() and s.length.sum() <= 4096


def test_slow_redaction_merges():
    assert slow_redaction("abcdefgh", [(1, 3, "x"), (2, 5, "y"), (5, 6, "z")]) == "a<x><z>gh"


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_their_own_empty_result(spark, name, stage):
    docs = table(spark, FOLDER, "documents").filter("false")
    assert stage(spark, docs, FOLDER).count() == 0
