"""Queries with SQL give DuckDB's rows; the pipeline and the entry hold together."""

from collections import Counter

import numpy as np
import pytest
import sentencepiece
from compare import both

from rasterloom.llm import queries

from . import test_operators as ops


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, sf, name):
    got, want = both(spark, sf, queries.queries()[name], queries.oracle_sql()[name])
    assert got == want


def test_pipeline(spark, sf):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = docs.columns, docs.count()
    seen = [n]
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen.append(docs.count())
    assert seen[1] < seen[0] and seen[2] <= seen[1] and seen[3] < seen[2]
    out = pipeline.STAGES[-1][1](spark, docs, sf)
    assert out.count() == seen[-1]


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with nulls in any column, empty texts, repeated rows and ids, a long text and clashing names."""
    import random

    rng = random.Random(21)

    def text(n):
        return " ".join("".join(rng.choice("abcdefghijklm") for _ in range(rng.randrange(2, 9))) for _ in range(n))

    base, shared = text(200), text(8)
    rows = [(i, text(rng.randrange(60, 200)) + (f"\n{shared}\n{text(20)}" if i % 3 else ""), ("en", "fr", None)[i % 3], ("s1", None, "s2")[i % 3]) for i in range(60)]
    near = base.split()
    rows += [(100 + i, " ".join([*near[: i + 3], f"edit{i}", *near[i + 4 :]]), "en", "s1") for i in range(6)]
    rows += [rows[4], rows[4], (5, text(90), "en", "s1"), (None, text(120), "en", "s1"), (None, rows[8][1], None, None), (2, "short", "en", "s1")]
    rows += [(200, None, "en", "s1"), (201, "", None, None), (202, "\n\n  \n", "en", None), (203, text(6000), "fr", "s2"), (None, None, None, None), (204, " | ".join(text(150).split()), "en", "s1")]
    return spark.createDataFrame([(*r, len(r[1] or ""), "x", 1, None) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, g string, n bigint, component_id bigint").repartition(3)


def bag(rows):
    return Counter(tuple(r) for r in rows)


def test_each_stage_against_a_plain_version(spark, odd):
    pipeline = pytest.importorskip("corpus_pipeline")
    sp = sentencepiece.SentencePieceProcessor(model_file=ops.MODEL)
    stages = dict(pipeline.STAGES)
    src = odd.collect()

    def again(rows):
        return spark.createDataFrame(rows, odd.schema).repartition(3)

    # Quality rules: each row by its own text.
    got = stages["quality rules"](spark, odd, "").collect()
    verdict = ops.plain_verdicts([(r.text, r.lang, r.source) for r in src])
    assert bag(got) == bag(r for r, v in zip(src, verdict) if v[0])
    assert any(r.doc_id is None for r in got) and not any(r.text == "short" for r in got) and sum(r.doc_id == 4 for r in got) == 3
    # Line dedup.
    src = got
    got = stages["line dedup"](spark, again(src), "").collect()
    want = [(r, k[2]) for r, k in zip(src, ops.plain_lines([r.text for r in src], pipeline.MIN_DOCS, 1)) if ops.WORD.search(k[2])]
    assert bag(got) == bag((r.doc_id, t, r.lang, r.source, len(t), r.g, r.n, r.component_id) for r, t in want)
    assert any(len(t) < len(r.text) for r, t in want)
    # Jaccard join: one row of each group, and of each repeated id.
    src = got
    got = stages["n-gram Jaccard join"](spark, again(src), "").collect()
    comp = ops.plain_components([(r.doc_id, r.text) for r in src if r.doc_id is not None], pipeline.PERCENT)
    keep = [r for r in src if r.doc_id is None]
    for i in {i for i, c in comp.items() if i == c}:
        keep.append(min((r for r in src if r.doc_id == i), key=lambda r: ops.sha(r.text)))
    assert bag(got) == bag(keep) and len(got) < len(src)
    # Mixing: each row as often as its source's threshold says, and near the targets.
    src = got
    got = stages["mixing sources"](spark, again(src), "").collect()
    sizes = Counter()
    for r in src:
        sizes[r.source] += len(ops.WORD.findall(r.text))
    target, taken, largest = ops.plain_targets(sizes), Counter(), Counter()
    n = bag(got)
    assert set(n) <= {tuple(r) for r in src}
    for r in src:
        assert n[tuple(r)] <= 2 * src.count(r)
        largest[r.source] = max(largest[r.source], len(ops.WORD.findall(r.text)))
    for r in got:
        taken[r.source] += len(ops.WORD.findall(r.text))
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in sizes)
    assert any(r.doc_id is None for r in got)
    # SentencePiece.
    out = stages["SentencePiece"](spark, again(got), "").collect()
    ids = [(r.doc_id, [1, *sp.encode(r.text), 2]) for r in got]
    assert bag(out) == Counter((d, len(i), ops.sha(np.array(i, "<u4").tobytes()), ops.sha(sp.decode(i))) for d, i in ids)


def test_stages_take_empty_tables(spark, odd):
    pipeline = pytest.importorskip("corpus_pipeline")
    for _, stage in pipeline.STAGES:
        assert stage(spark, odd.limit(0), "").count() == 0


def test_every_stage_takes_odd_rows_by_itself(spark, odd):
    """Null and empty texts reach the later stages too."""
    pipeline = pytest.importorskip("corpus_pipeline")
    n = odd.count()
    kept = {name: stage(spark, odd, "").count() for name, stage in pipeline.STAGES}
    assert kept["SentencePiece"] == n and 0 < kept["line dedup"] < n and 0 < kept["n-gram Jaccard join"] < n
