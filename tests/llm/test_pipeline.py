"""The corpus pipeline, stage by stage, against brute force."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from skeinql.llm import op02_language_id as lang
from skeinql.llm.common import table_of
from test_operators import DATA, brute_classes, brute_hits

pipeline = pytest.importorskip("corpus_pipeline")


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def held_against_brute_force(spark, docs):
    """Runs the stages on docs and compares what each keeps with a plain loop over the same rows; gives the last result."""
    names = docs.columns
    at = {c: names.index(c) for c in ("doc_id", "text", "source")}
    bench = [(str(r.item_id), r.text) for r in table_of(spark, DATA, "benchmark").collect() if r.text is not None and r.item_id is not None]
    for name, stage in pipeline.STAGES[:-1]:
        before, docs = rows_of(docs), stage(spark, docs, DATA).cache()
        assert docs.columns == names
        after = Counter(rows_of(docs))
        if name == "language":
            own = lang.compressors(lang.fit_dictionaries(spark.createDataFrame(before, docs.schema)))
            judged = [lang.classify(r[at["text"]], own) for r in before]
            assert after == Counter(r for r, (x, _, m) in zip(before, judged) if x != "und" and m >= lang.MIN_MARGIN)
        elif name == "near_dedup":
            texts = {}
            for r in before:
                if r[at["doc_id"]] is not None:
                    assert texts.setdefault(r[at["doc_id"]], r[at["text"]]) == r[at["text"]]
            want = {i for i, c in brute_classes(texts).items() if i == c}
            assert Counter(r[at["doc_id"]] for r in after) == Counter([*want, *(None for r in before if r[at["doc_id"]] is None)])
            assert set(after) <= set(before)
        elif name == "decontaminate":
            assert after == Counter(r for r in before if not brute_hits(r[at["text"]], bench)[1])
        else:
            size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r[at["text"]] or ""))
            assert set(after) <= set(before) and max(after.values(), default=0) <= 2 * max(Counter(before).values(), default=1)
            total, taken = Counter(), Counter()
            for r in before:
                total[r[at["source"]]] += size(r)
            for r, n in after.items():
                taken[r[at["source"]]] += n * size(r)
            order = sorted(total, key=lambda s: (s is None, s or ""))
            weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
            target, free, left = {}, set(order), 1.5 * sum(total.values())
            while free:
                unit = left / sum(weight[s] for s in free)
                full = {s for s in free if 2 * total[s] < unit * weight[s]}
                target |= {s: 2 * total[s] for s in full} if full else {s: unit * weight[s] for s in free}
                left -= sum(2 * total[s] for s in full)
                free = free - full if full else set()
            for s in order:
                longest = max((size(r) for r in before if r[at["source"]] == s), default=0)
                assert abs(taken[s] - target[s]) <= longest
    return docs, pipeline.STAGES[-1][1](spark, docs, DATA)


def token_rows(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer, out, start = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), [], 0
    for r in sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0)):
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
        out.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_stages_equal_brute_force(spark):
    docs, tokens = held_against_brute_force(spark, table_of(spark, DATA, "documents"))
    assert sorted(rows_of(tokens.select("doc_id", "start", "n_tokens", "ids_crc32"))) == sorted(token_rows(docs))


def test_stages_on_odd_documents(spark, odd_documents):
    docs, tokens = held_against_brute_force(spark, odd_documents)
    assert tokens.count() == docs.count()


def test_run_equals_its_stages(spark):
    docs = table_of(spark, DATA, "documents")
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, DATA)
    assert Counter(rows_of(docs)) == Counter(rows_of(pipeline.run(spark, DATA)))


def test_stages_on_no_documents(spark, no_documents):
    empty = no_documents
    for _, stage in pipeline.STAGES:
        empty = stage(spark, empty, DATA)
    assert empty.count() == 0
