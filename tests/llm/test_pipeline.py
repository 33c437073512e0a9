"""The pipeline against brute force, its decisions, odd tables, and the queries that have SQL."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from check_oracles import compare
from chronofold.llm import lexicon, queries
from test_operators import reach, slow_matches, slow_schedule

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"


def test_oracles(spark):
    for name, sql in queries.ORACLE_SQL.items():
        assert compare(spark, SF, name, queries.QUERIES[name], sql) == ""


def slow_pipeline(docs, labels, items):
    """(doc_id, start, n_tokens, checksum) of each row, by plain Python."""
    from tokenizers import Tokenizer

    # toxicity
    sure = {i: y for i, y in labels if y in (0, 1) and zlib.crc32(str(i).encode()) % 5 != 0}
    learned = lexicon.learn(sorted(((t or "", sure[i]) for i, t, _ in docs if i in sure), key=lambda r: (r[0], r[1])))
    docs = [d for d in docs if learned.score(d[1]) < 0.5]
    # near copies
    sets = []
    for _, t, _ in docs:
        words = (t or "").encode().lower().split()
        sets.append({tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set()))
    links = [(a, b) for a in range(len(docs)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    of = reach(range(len(docs)), links)
    least = {}
    for k, (i, _, _) in enumerate(docs):
        least[of[k]] = min(i, least.get(of[k], i))
    docs = [d for k, d in enumerate(docs) if d[0] == least[of[k]]]
    # contamination
    docs = [d for d in docs if not slow_matches(d[1] or "", items)]
    # mixing
    by_source = {}
    for i, t, source in sorted(docs):
        by_source.setdefault("" if source is None else "=" + source, []).append((i, t))
    sizes = {s: -(-len(own) // 32) for s, own in by_source.items()}
    raised = {s: n**0.7 for s, n in sizes.items()}
    slots = max(256.0, sum(raised.values()) / min(raised.values()))
    weights = {s: max(1, int(x * slots / sum(raised.values()) + 0.5)) for s, x in raised.items()}
    placed = sorted((slot, s, b) for (s, b), slot in slow_schedule(sizes, weights).items())
    order = [d for _, s, b in placed for d in by_source[s][32 * b : 32 * b + 32]]
    # token ids
    tokenizer, out, start = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), [], 0
    for i, t in order:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_pipeline_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "source").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", "toxic").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    want = slow_pipeline(docs, labels, items)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, SMALL).collect())
    assert 0 < len(want) < len(docs) and [(d, s, n, c) for s, d, n, c in got] == want


def test_stages_filter_and_keep_columns(spark):
    kept = spark.read.parquet(f"{SF}/documents.parquet")
    columns = kept.columns
    for _, stage in corpus_pipeline.STAGES[:3]:
        before = kept
        kept = corpus_pipeline.cut(stage(spark, before, SF), "kept")
        assert kept.columns == columns
        gone = before.join(kept, "doc_id", "left_anti").count()
        assert 0 < gone < 0.25 * before.count()


def test_odd_and_empty_documents(spark, odd, none, tmp_path):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").write.parquet(f"file://{tmp_path}/{name}.parquet")
    for table, rows in ((odd, {None: 1, -9: 1, 1: 1, 3: 1, 6: 1, 7: 1, 8: 1}), (none, {})):
        table.write.mode("overwrite").parquet(f"file://{tmp_path}/documents.parquet")
        got = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
        assert Counter(r.doc_id for r in got) == Counter(rows) or set(Counter(rows)) - {r.doc_id for r in got} <= {-9}  # the rude one may go
        assert [r.start for r in sorted(got, key=lambda r: r.start)] == list(np.cumsum([0] + [r.n_tokens for r in sorted(got, key=lambda r: r.start)])[:-1])
    empty = odd.limit(0).select("doc_id", "text", "source", "lang", "n_chars")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, f"file://{tmp_path}").count() == 0
