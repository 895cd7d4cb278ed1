"""Each operator against a plain version, over nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from rasterloom.llm import common, flac, graph, jaccard, language_id, licenses, lines, mixing, quality, sentence_pieces, suffixes, token_counts

from .conftest import sha

MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


# 1

def test_language_id(spark, docs, empty):
    rows = [(i, ("the cat and the dog " if i % 2 else "le chat et la souris ") * 5, "en" if i % 2 else "fr") for i in range(60)]
    rows += [(100, None, "en"), (101, "", "en"), (102, "123 !?", "fr"), (103, "the dog", None)]
    out = {r.doc_id: r for r in language_id.language_id(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert all(out[i].lang_pred == ("en" if i % 2 else "fr") for i in range(60))
    assert [out[i].lang_pred for i in (100, 101, 102, 103)] == ["und", "und", "und", "en"]
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in out.items())
    assert language_id.language_id(empty).count() == 0
    assert language_id.language_id(docs).count() == docs.count()


def plain_bayes(train, texts):
    """Predictions of a multinomial naive Bayes with a dictionary of the hashed n-grams, in plain loops."""
    import math

    counts, docs = {}, Counter()
    for t, lang in train:
        if t and any(c.isalpha() for c in t):
            counts.setdefault(lang, Counter()).update(language_id.buckets(language_id.points(t)).tolist())
            docs[lang] += 1
    total = {k: sum(c.values()) + language_id.ALPHA * language_id.BUCKETS for k, c in counts.items()}
    out = []
    for t in texts:
        if not t or not any(c.isalpha() for c in t):
            out.append("und")
            continue
        grams = Counter(language_id.buckets(language_id.points(t)).tolist())
        s = {k: math.log(docs[k] / sum(docs.values())) + sum(n * math.log((counts[k][g] + language_id.ALPHA) / total[k]) for g, n in grams.items()) for k in counts}
        out.append(max(sorted(s), key=s.get))
    return out


def test_language_id_against_plain_bayes(spark):
    import random

    rng = random.Random(3)
    letters = {"aa": "abcdefgh", "bb": "cdefghij", "cc": "efghijkl", "dd": "ghijklmn"}

    def text(lang, n):
        return " ".join("".join(rng.choice(letters[lang]) for _ in range(rng.randrange(2, 6))) for _ in range(n))

    rows = [(i, text(k := rng.choice("aaabbcd") * 2, rng.choice((1, 2, 3, 8, 400))), k) for i in range(240)]
    rows += [(500, "", "aa"), (501, None, "bb"), (502, "12 34", "cc"), (503, text("aa", 3000) + text("dd", 2900), None)]
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    want = plain_bayes([(t, lang) for i, t, lang in rows if lang and not held(i)], [t for _, t, _ in rows])
    out = {r.doc_id: r for r in language_id.language_id(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert [out[i].lang_pred for i, _, _ in rows] == want
    assert all(0 <= r.score <= 1 for r in out.values()) and sum(w != (r[2] or w) for w, r in zip(want, rows)) > 0


def test_many_languages_are_all_learned(monkeypatch, spark):
    monkeypatch.setattr(language_id, "CELLS", 1 << 16)  # 600 languages leave fewer buckets
    rows = [(i, f"{chr(0x4E00 + i)}{chr(0x4E00 + i)} " * 5, f"l{i:03d}") for i in range(600)]
    langs, logp = language_id.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert len(langs) == 600 and logp.shape[1] - 1 == 64
    assert logp.size <= (1 << 16) + 600


def test_long_texts_count_as_whole(monkeypatch):
    t = "ab cd efg " * 50
    ids, n = language_id.counts(t)
    monkeypatch.setattr(language_id, "CHUNK", 64)
    again = language_id.counts(t)
    assert (ids == again[0]).all() and (n == again[1]).all()


def test_held_out_accuracy(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    out = language_id.language_id(d).where("held_out").join(d.select("doc_id", "lang"), "doc_id").where("lang is not null")
    assert out.where("lang_pred = lang").count() >= 0.95 * out.count()


# 2

def test_token_counts(spark, docs, empty, sp, tmp_path):
    cache = f"file://{tmp_path}/cache"
    out = token_counts.token_counts(docs, MODEL, cache, limit=100)
    texts = Counter((r.doc_id, r.text) for r in docs.collect())
    want = Counter()
    for (d, t), k in texts.items():
        n = len(sp.encode(t or ""))
        want[d, len((t or "").encode()), n, n > 100] += k
    assert Counter(map(tuple, out.collect())) == want
    stored = spark.read.parquet(cache)
    assert stored.count() == len({t or "" for _, t in texts})
    # All hits: nothing is appended. A shuffle in place of the broadcast gives the same.
    assert Counter(map(tuple, token_counts.token_counts(docs, MODEL, cache, limit=100, id_rows=0).collect())) == want
    assert spark.read.parquet(cache).count() == stored.count()
    assert Counter(map(tuple, token_counts.token_counts(docs, MODEL, f"file://{tmp_path}/other", limit=100, id_rows=0).collect())) == want
    assert token_counts.token_counts(empty, MODEL, f"file://{tmp_path}/none").count() == 0


def test_json_tokenizers_count_as_their_library(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, path, f"file://{tmp_path}/c").collect()}
    assert all(got[r.doc_id] == len(t.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect())


# 3

def test_license_forms(spark, docs, empty):
    mit = licenses.KNOWN["MIT"]
    same = ["Copyright (c) 2020 A. Author\n\n" + mit.upper(), mit.replace(",", " ;").replace("sublicense", "sub-licence"), "  © 1999 B\n" + mit + "\n"]
    rows = [(i, t) for i, t in enumerate(same)] + [(10, mit + " more"), (11, None), (12, ""), (13, "...")]
    out = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string"), licenses.known(spark)).collect()}
    assert [out[i].license_id for i in range(3)] == ["MIT"] * 3
    assert out[10].license_id is None and out[11].license_id is None
    assert out[11].canonical_sha256 == out[12].canonical_sha256 == out[13].canonical_sha256 == sha("")
    assert licenses.scan(docs, licenses.known(spark), of_lines=True).count() == docs.count()
    assert licenses.scan(empty, licenses.known(spark), of_lines=True).count() == 0
    notice = spark.createDataFrame([(1, "x\nReleased under the MIT license!\nlicence to y"), (2, None)], "doc_id bigint, text string")
    assert {r.doc_id: r.n_license_lines for r in licenses.scan(notice, licenses.known(spark), True).collect()} == {1: 1, 2: 0}


def plain_license_form(t):
    notice = re.compile(r"[\W\d_]*(copyright[ \t:,]*[(<\[{©0-9].*|©.*|\(c\)[ \t]*[<\[{0-9].*|all rights reserved[\W\d_]*)")
    t = "\n".join(x for x in (t or "").lower().split("\n") if not notice.fullmatch(x))
    t = " " + "  ".join(x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", t) if x) + " "
    for old, new in licenses.SPELLINGS:
        t = t.replace(f" {old.replace(' ', '  ')} ", f" {new.replace(' ', '  ')} ")
    return " ".join(t.split())


def test_whole_licenses_are_found_as_they_are_met(spark):
    """Titled, under a notice, re-wrapped, in capitals, spelt otherwise: against a plain version of the form."""
    import textwrap

    forms = {}
    for name, text in licenses.forms():
        forms.setdefault(plain_license_form(text), set()).add(name)
    rows, want = [], {}
    for name, text in dict(licenses.forms()).items():
        for k, t in enumerate((text, "Copyright (c) 2020, A. Author\nAll rights reserved.\n\n" + text, textwrap.fill(text, 41), text.upper(), "/* " + text.replace("\n", "\n * ") + " */", text + " Or so.")):
            rows.append((len(rows), t))
            want[len(rows) - 1] = min(forms.get(plain_license_form(t), {None}), key=str)
            # Some texts have notices of their own within, which a re-wrapped line no longer starts with.
            assert k in (2, 5) or want[len(rows) - 1] == name, (name, k)
    out = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string"), licenses.known(spark), True).collect()}
    assert {i: r.license_id for i, r in out.items()} == want
    assert all(out[i].canonical_sha256 == sha(plain_license_form(t)) for i, t in rows)
    found = {w for w in want.values() if w}
    assert len(found) >= 25 and {"MIT", "BSD-3-Clause", "Apache-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "CC0-1.0", "ISC", "Zlib"} <= found
    wrapped = [w for i, w in want.items() if i % 6 == 2]
    assert sum(w is not None for w in wrapped) >= 20


def test_license_lines_need_no_particular_word(spark):
    own = licenses.known(spark, {"unlicensed-words": "Do what you like with this."})
    docs = spark.createDataFrame([(1, "a\nDo what you like with this!\nb\n do what you like with this"), (2, "a\nb"), (3, None)], "doc_id bigint, text string")
    assert {r.doc_id: r.n_license_lines for r in licenses.scan(docs, own, True).collect()} == {1: 2, 2: 0, 3: 0}
    assert licenses.scan(docs, own.drop("first_word"), True).sort("doc_id").collect() == licenses.scan(docs, own, True).sort("doc_id").collect()
    spelt = licenses.known(spark, {"spelt": "Licence of Acme", "start": "Non commercial use"})
    docs = spark.createDataFrame([(1, "x\n* LICENSE of acme.\nnoncommercial use\nnon-commercial use"), (2, "the licence of Acme")], "doc_id bigint, text string")
    assert {r.doc_id: r.n_license_lines for r in licenses.scan(docs, spelt, True).collect()} == {1: 3, 2: 0}


# 4

def plain_statistics(t):
    t = t or ""
    w = WORD.findall(t)
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    ls = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(ls) - len(set(ls)), len(hit)


def test_quality_statistics(texts):
    more = ["a b c a b c a b c", "a a a a a", "x\nx\n x\nx", "# | <b>", "q w e r q w e"]
    for t in [*texts, *more]:
        assert quality.statistics(t) == plain_statistics(t)


def plain_fit(x, half=quality.HALF):
    """The MCD of rows x from the operator's three starts, with exact subsets: centre, scatter, n."""
    n, floor = len(x), np.array(quality.FLOOR)
    mid = np.median(x, 0)
    d = np.maximum(1.4826 * np.median(np.abs(x - mid), 0), floor)
    z = (x - mid) / d
    best = None
    for y in (None, np.tanh(z), z / np.sqrt((z**2).sum(1, keepdims=True) + 1e-12)):
        c = np.eye(5)
        if y is not None:
            c = y.T @ y
            size = np.sqrt(np.maximum(np.diag(c), 1e-6))
            c = c / np.outer(size, size)
            np.fill_diagonal(c, 1)
        fit, low = (mid, quality.bounded(c * np.outer(d, d))), np.inf
        while True:
            r = x - fit[0]
            o = np.argsort(np.einsum("ij,jk,ik->i", r, np.linalg.inv(fit[1]), r), kind="stable")[: int(np.ceil(half * n))]
            new = x[o].mean(0), quality.bounded(np.cov(x[o].T, bias=True) * quality.consistency(half))
            det = np.linalg.slogdet(new[1])[1]
            if det >= low - 1e-6:
                break
            fit, low = new, det
        if best is None or low < best[0]:
            best = low, *fit
    return best[1], best[2], n


def plain_verdicts(rows):
    """kept and distance of (text, lang, source) rows by plain fits."""
    stats = [plain_statistics(t) for t, _, _ in rows]
    x = [np.round(np.array([np.log(max(n, 1)), np.log(max(c / max(n, 1), 0.25)), np.sqrt(min(s / max(n, 1), 16)), np.sqrt(d / max(n, 1)), np.sqrt(r / max(n, 1))]) * quality.SCALE) / quality.SCALE for n, c, s, d, r in stats]
    ok = [n >= 50 and 100 * r <= 50 * n for n, _, _, _, r in stats]
    fits = {}
    for key in {k for _, lang, src in rows for k in ((lang,), (lang, src))}:
        own = [x[i] for i, r in enumerate(rows) if ok[i] and r[1 : 1 + len(key)] == key]
        if own:
            fits[key] = plain_fit(np.array(own))
    out = []
    for i, (_, lang, src) in enumerate(rows):
        if (lang, src) not in fits:
            out.append((False, None))
            continue
        (c, s, n), (cl, sl, nl) = fits[lang, src], fits[lang,]
        wide = (nl * sl + quality.PRIOR * np.diag(np.array(quality.WIDE) ** 2)) / (nl + quality.PRIOR)
        cov = quality.bounded((n * s + quality.PRIOR * wide) / (n + quality.PRIOR))
        r = x[i] - (n * c + quality.PRIOR * cl) / (n + quality.PRIOR)
        d2 = r @ np.linalg.inv(cov) @ r
        out.append((ok[i] and d2 <= quality.CUTOFF, d2))
    return out


def test_quality_verdicts(spark, docs, empty):
    src = docs.collect()
    out = quality.judged(docs).collect()
    assert len(out) == len(src) and "lang" in quality.judged(docs).columns and "text" not in quality.judged(docs).columns
    for r in out:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    assert quality.judged(empty).count() == 0 and quality.kept_rows(empty).count() == 0
    bare = quality.judged(docs.select("doc_id", "text"))  # one group: no language, no source
    assert bare.columns == ["doc_id", *quality.NAMES] and bare.count() == len(src)
    assert quality.judged(docs.withColumn("kept", F.lit("x")).withColumn("g", F.lit(1))).columns == [*(c for c in docs.columns if c != "text"), "g", *quality.NAMES]


def test_quality_against_plain_estimates(spark):
    rng = np.random.default_rng(8)

    def text(n, lo, hi, junk=0.0, twice=False):
        w = ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(lo, hi))) for _ in range(n)]
        w = [x + " |" if rng.random() < junk else x for x in w]
        k = len(w) // 6
        return " ".join(w) + ("\n" + " ".join(w[:k]) if twice else "")

    rows = []
    for lang, src, n, lo, hi in (("en", "a", 300, 2, 9), ("en", "b", 150, 3, 10), ("xx", "a", 60, 20, 40), (None, None, 25, 2, 9), ("yy", "c", 2, 5, 9)):
        for i in range(n):
            rows.append((text(int(rng.integers(30, 500)), lo, hi, 0.6 if i % 9 == 4 else 0.01, i % 7 == 3), lang, src))
    rows += [("", "en", "a"), (None, "en", "b"), ("short", "zz", "q")]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id bigint, text string, lang string, source string").repartition(3)
    got = {r.doc_id: (r.kept, r.distance2) for r in quality.judged(d).collect()}
    want = plain_verdicts(rows)
    same = sum(got[i][0] == w[0] for i, w in enumerate(want))
    assert same >= len(rows) - 1
    assert all(got[i][0] == w[0] for i, w in enumerate(want) if w[1] is None or not 0.8 < w[1] / quality.CUTOFF < 1.25)
    assert 30 < sum(not w[0] and len((rows[i][0] or "").split()) >= 50 for i, w in enumerate(want)) and sum(w[0] for w in want) > 300
    # The rows kept are those judged so, with all their columns.
    kept = quality.kept_rows(d)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {i for i, g in got.items() if g[0]}


def test_determinants_fall(spark):
    """The estimate has no greater determinant than any start, and equals the exact subset's within the bins."""
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(600, 5)) @ np.diag([900, 300, 300, 300, 300]) + np.outer(rng.normal(size=600), [500, 200, 0, 0, 0])).astype(int)
    x[:80] += 4000
    df = spark.createDataFrame([("g", *map(int, r)) for r in x], "g string, " + ", ".join(f"{k} bigint" for k in quality.STATS))
    fit = quality.estimates(df, 1).first()
    centre, scatter, _ = plain_fit(x / quality.SCALE)
    assert fit.n == 600 and np.abs(np.array(fit.centre) - centre).max() < 0.05
    assert abs(fit.logdet - np.linalg.slogdet(scatter)[1]) < 0.3
    assert np.abs(np.array(fit.centre) - x[80:].mean(0) / quality.SCALE).max() < 0.15


def test_outliers_go_and_others_stay(spark):
    rng = np.random.default_rng(1)
    def text(i):
        return " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(rng.integers(60, 400)))

    rows = [(i, text(i) if i % 10 else " | ".join(text(i).split()), "en", "s") for i in range(600)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    out = {r.doc_id: r.kept for r in quality.judged(d).collect()}
    assert not any(out[i] for i in range(0, 600, 10))
    assert sum(out[i] for i in range(600) if i % 10) >= 535
    again = {r.doc_id: (r.kept, r.distance2) for r in quality.judged(d.repartition(7)).collect()}
    first = {r.doc_id: (r.kept, r.distance2) for r in quality.judged(d).collect()}
    assert again == first  # sums are exact, so the order of rows doesn't matter


def test_small_languages_are_judged_by_themselves(spark):
    rng = np.random.default_rng(2)
    def text(lo, hi):
        return " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(lo, hi))) for _ in range(rng.integers(60, 400)))

    rows = [(i, text(2, 9), "en", "s") for i in range(300)] + [(300 + i, text(25, 40), "xx", "s") for i in range(40)]
    rows += [(340 + i, " | ".join(text(25, 40).split()), "xx", "s") for i in range(4)] + [(344 + i, text(25, 40), "yy", "s") for i in range(5)]
    out = {r.doc_id: r for r in quality.judged(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    assert sum(out[i].kept for i in range(300, 340)) >= 38
    assert not any(out[i].kept for i in range(340, 344))
    assert all(out[i].kept for i in range(344, 349))


def test_cutoff_is_a_quantile():
    assert abs(quality.quantile(0.95) - 11.0705) < 1e-3 and abs(quality.quantile(0.999) - 20.515) < 1e-3
    assert quality.CUTOFF == quality.quantile(1 - quality.TAIL)


# 5

def plain_lines(texts, least_docs, least):
    keys = [[lower(x.strip(" \t\n\x0b\x0c\r")) for x in (t or "").split("\n")] for t in texts]
    n = Counter(k for ks in keys for k in {k for k in ks if len(k) >= least})
    out = []
    for t, ks in zip(texts, keys):
        ls = (t or "").split("\n")
        keep = [x for x, k in zip(ls, ks) if n[k] < least_docs]
        out.append((len(ls), len(ls) - len(keep), "\n".join(keep)))
    return out


@pytest.mark.parametrize(("bits", "bad", "least"), [(1 << 27, 10**6, 1), (1 << 14, 0, 1), (3 << 15, 0, 3), (1 << 13, 0, 1)])
def test_line_dedup(spark, docs, empty, bits, bad, least):
    src = docs.collect()
    want = Counter((r.doc_id, *w) for r, w in zip(src, plain_lines([r.text for r in src], 5, least)))
    out = lines.dedup_lines(docs, 5, least, bits, bad)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect()) == want
    assert sum(w[1] for w in want) > 0 or least
    assert lines.dedup_lines(empty, 5, least, bits, bad).count() == 0


def test_filters_have_no_false_negatives():
    rng = np.random.default_rng(0)
    size = 3 * lines.SLICES * 8 * lines.FOLD
    a, b = rng.integers(0, size, 9000).astype(np.uint32), rng.integers(0, size, 9000).astype(np.uint32)
    a[:300] = 77
    n = np.bincount(np.concatenate([a, b]), minlength=size)
    for counted in (False, True):
        rows = {}
        for x in (a, b):
            for s, p, m in lines.packed(x, size, counted):
                rows.setdefault(s, []).append((p, m))
        if not counted:
            got = b"".join(lines.merged(rows.get(s, []), size) for s in range(lines.SLICES))
        else:
            parts = [lines.merged_counts(rows.get(s, []), size, 200) for s in range(lines.SLICES)]
            got = b"".join(x[: size // lines.SLICES // 8] for x in parts)
            hot = np.unpackbits(np.frombuffer(b"".join(x[size // lines.SLICES // 8 :] for x in parts), np.uint8))
            assert np.flatnonzero(hot).tolist() == [77 // lines.FOLD]
        assert (np.unpackbits(np.frombuffer(got, np.uint8)).astype(bool) == (n > 1)).all()
    pos = lines.positions(rng.integers(0, 2**64, 1000, dtype=np.uint64), size)
    assert pos.max() < size and pos.min() >= 0


def test_a_full_filter_only_costs_digests(spark):
    """With a filter that suspects every line, digests and ids are shuffled, however long the lines are."""
    rows = [(i, "\n".join(f"{i} line {k} " + "x" * 500 for k in range(5))) for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    sus = lines.suspects(d, 1, 1 << 13)
    assert dict(sus.dtypes) == {"digest": "binary", "doc_id": "bigint", "text_hash": "bigint"}
    assert all(len(r.digest) == 16 for r in sus.collect())


# 6

def plain_sets(t, k=5):
    w = WORD.findall(lower(t or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset()


def plain_components(rows, percent):
    ids = {i for i, _ in rows}
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [(i, plain_sets(t)) for i, t in rows]
    for x, (i, a) in enumerate(sets):
        for j, b in sets[x + 1 :]:
            both = len(a & b)
            if both and 100 * both >= percent * len(a | b):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("percent", [80, 50])
def test_jaccard_join(spark, docs, empty, percent):
    src = [(r.doc_id, r.text) for r in docs.collect()]
    want = plain_components([x for x in src if x[0] is not None], percent)
    out = jaccard.near_duplicates(docs, percent).collect()
    assert len(out) == len(src)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == Counter((i, len(plain_sets(t)), want.get(i)) for i, t in src)
    assert jaccard.near_duplicates(empty).count() == 0


def test_jaccard_chains_and_hubs(spark):
    """Chains of edits, where ends don't link, and a passage that many short texts are mostly made of."""
    import random

    rng = random.Random(11)
    w = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(12):
        rows.append((i, " ".join(w)))
        w = w[1:] + [f"n{i}"]
    for i in range(25):
        rows.append((100 + i, " ".join([f"p{k}" for k in range(12)] + [f"u{i}x{k}" for k in range(rng.randrange(0, 6))])))
    want = plain_components(rows, 80)
    out = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4))
    assert {r.doc_id: r.component_id for r in out.collect()} == want


def test_components_of_a_path_and_a_star(spark):
    e = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 30)] + [(7, 7)]
    out = {r.node: r.component for r in graph.components(spark.createDataFrame(e, "a bigint, b bigint")).collect()}
    assert out == {**{i: 0 for i in range(41)}, **{1000 + i: 1000 for i in range(30)}}


# 7

@pytest.mark.parametrize(("length", "hot", "id_rows"), [(100, None, 10**6), (100, 1, 0), (160, None, 0), (40, 2, 10**6), (400, None, 10**6)])
def test_suffix_dedup(spark, docs, empty, length, hot, id_rows):
    src = sorted(((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in docs.collect()))
    one = sorted(set(src))
    want = dict(zip([i for i, _ in one], zip([t.encode() for _, t in one], suffixes.brute_force([t.encode() for _, t in one], length))))
    out = suffixes.remove_repeats(docs, length, hot, id_rows).collect()
    assert len(out) == len(src)
    for r in out:
        text, kept = want[-1 if r.doc_id is None else r.doc_id]
        assert (r.n_bytes, r.n_removed, bytes(r.kept)) == (len(text), len(text) - len(kept), kept)
    assert any(r.n_removed for r in out)
    assert suffixes.remove_repeats(empty, length, hot).count() == 0


@pytest.mark.parametrize("length", [100, 160, 200, 400, 1000])
def test_windows_that_part_late_are_told_apart(length):
    """Equal for the first 140 bytes and more, different only near the end: every class keeps its first, at any length."""
    rng = np.random.default_rng(4)
    head = rng.integers(97, 123, length - 10).astype(np.uint8).tobytes()
    block = [(i, 0, 0, head + bytes([65 + i % 3]) * 10) for i in range(30)]
    doc, tie, first, last = suffixes.repeats(block, length)
    assert sorted(doc.tolist()) == list(range(3, 30)) and not first.any() and not last.any()
    # Cover ranks are the ranks of suffixes by that many bytes.
    t = b"".join(r[3] for r in block)
    text = np.frombuffer(t + bytes(suffixes.spare(length)), np.uint8)
    rank = suffixes.cover_ranks(text, len(text) - 64, length)
    places = [p for p in range(0, len(t), 7) if p % suffixes.V in suffixes.COVER]
    keys = {p: text[p : p + length].tobytes() for p in places}
    some = sorted(places, key=lambda p: rank[p])
    assert all(keys[p] <= keys[q] for p, q in zip(some, some[1:]))


def test_a_hot_anchor_is_spread(spark):
    """One string in very many surroundings: no task gets all of them in one block."""
    rng = np.random.default_rng(7)
    middle = "m" * 10 + "".join(chr(97 + c) for c in rng.integers(0, 26, 60))
    pad = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, 60))
    rows = [(i, pad() + middle + pad()) for i in range(400)] + [(1000, "x" * 5 + pad()), (1001, None)]
    rows.append((500, rows[3][1][20:] + "tail"))
    want = suffixes.brute_force([(t or "").encode() for _, t in sorted(rows)], 100)
    # What one anchor below the bound brings to a block is less than a block.
    assert suffixes.HOT * (2 * 100 - suffixes.K) <= suffixes.BLOCK
    d = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    for hot in (None, 50):
        out = {r.doc_id: bytes(r.kept) for r in suffixes.remove_repeats(d, 100, hot).collect()}
        assert [out[i] for i, _ in sorted(rows)] == want
    found = suffixes._singles((1, 0, 5, 7), b"q" * 102, 100)
    assert [w[:4] for w, _, _ in found] == [(1, 0, 5, 5), (1, 0, 6, 6), (1, 0, 7, 7)]


def test_cover_reaches_every_difference():
    for a in range(suffixes.V):
        for b in range(suffixes.V):
            d = suffixes.SHIFT[a, b]
            assert 0 <= d < suffixes.V and (a + d) % suffixes.V in suffixes.COVER and (b + d) % suffixes.V in suffixes.COVER


def test_suffix_order_is_by_content():
    rng = np.random.default_rng(2)
    t = np.concatenate([np.tile(rng.integers(97, 100, 41), 30), rng.integers(97, 99, 900), np.zeros(suffixes.spare(100), int)]).astype(np.uint8)
    at = np.arange(0, 2000, 3)
    got = suffixes._order(t, at, 100)
    keys = [t[i : i + 100].tobytes() for i in got]
    assert sorted(got.tolist()) == at.tolist() and keys == sorted(keys)


def test_overlapping_repeats_in_one_text(spark):
    rows = [(1, "ab" * 300), (2, "x" * 99), (3, "x" * 101), (4, "q" + "ab" * 60), (5, None)]
    want = suffixes.brute_force([(t or "").encode() for _, t in rows], 100)
    out = {r.doc_id: r for r in suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [bytes(out[i].kept) for i, _ in rows] == want
    assert out[1].n_spans == 1 and out[5].n_bytes == 0


def test_long_texts_are_cut_into_overlapping_parts(monkeypatch):
    monkeypatch.setattr(suffixes, "CHUNK", 300)
    rng = np.random.default_rng(9)
    t = rng.integers(97, 123, 1500).astype(np.uint8).tobytes()
    owner, first, last, _ = suffixes.runs([t, t[500:1300]], 100)
    assert sorted(x for o, a, z in zip(owner, first, last) if o == 0 for x in range(a, z + 1)) == list(range(1401))


# 8

def test_sentence_pieces(spark, docs, empty, sp):
    src = Counter((r.doc_id, r.text) for r in docs.collect())
    got = sentence_pieces.encode_decode(docs, MODEL).collect()
    want = Counter()
    for (d, t), k in src.items():
        ids = [1, *sp.encode(t or ""), 2]
        want[d, len(ids), np.array(ids, "<u4").tobytes(), sp.decode(ids)] += k
    assert Counter((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in got) == want
    assert sentence_pieces.encode_decode(empty, MODEL).count() == 0
    digests = {r.doc_id: (r.ids_sha256, r.decoded_sha256) for r in sentence_pieces.encode_decode(docs, MODEL, digests=True).collect()}
    assert all(digests[r.doc_id] == (sha(bytes(r.ids)), sha(r.decoded)) for r in got)


def test_codec_on_random_texts(sp):
    import random

    rng = random.Random(1)
    parts = ["a", "b", "the", "ing", " ", "  ", "\n", "é", "▁", "1", "日", "🙂", "</s>", "<0x41>", ".", "er", "E", "  \t", "​", " " * 17, "aaaa"]
    c = sentence_pieces.codec(MODEL)
    count = token_counts.counter(MODEL)
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(0, 40)))
        ids = sp.encode(t)
        assert np.frombuffer(c.encode(t), "<u4").tolist() == ids
        assert count([t]) == [len(ids)]
    for _ in range(500):
        ids = [rng.randrange(32000) for _ in range(rng.randrange(0, 9))]
        assert c.decode(np.array(ids, "<u4").tobytes()).decode() == sp.decode(ids)


# 9

def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted((k for k in sizes if k is not None)) + [None] * (None in sizes)
    w = {k: weights[i % 3] for i, k in enumerate(names)}
    target, rest, free = {}, share * sum(sizes.values()), set(names)
    while True:
        level = rest / sum(w[k] for k in free) if free else 0
        over = {k for k in free if w[k] * level > most * sizes[k]}
        if not over:
            return target | {k: w[k] * level for k in free}
        target |= {k: most * sizes[k] for k in over}
        rest -= sum(most * sizes[k] for k in over)
        free -= over


def test_mixing(spark, docs, empty):
    src = docs.collect()
    sizes = Counter()
    for r in src:
        sizes[r.source] += len(WORD.findall(r.text or ""))
    want = plain_targets(sizes)
    out = mixing.mix(docs).collect()
    assert len(out) == len(src)
    taken, largest = Counter(), Counter()
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[k] - want[k]) <= largest[k] for k in sizes)
    again = mixing.mix(docs.repartition(5)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, out))
    assert mixing.mix(empty).count() == 0


def test_targets_by_rounds(spark):
    rng = np.random.default_rng(6)
    for _ in range(4):
        sizes = {f"s{i:02d}": int(10 ** rng.uniform(0, 6)) for i in range(9)} | {None: 500, "zero": 0}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
        got = {r.source: r.target for r in mixing.targets(df).collect()}
        assert got == pytest.approx(plain_targets(sizes))


def test_budgets_are_nested(spark):
    sized = spark.range(2000).select(F.lit("s").alias("source"), (F.col("id") % 50).alias("size"), mixing.hash30(F.col("id")).alias("h"))
    cuts = mixing.thresholds(sized, spark.createDataFrame([("s", float(b)) for b in (100, 5000, 20000)], "source string, budget double"), 1)
    got = sorted((r.budget, r.cut) for r in cuts.collect())
    assert [c for _, c in got] == sorted(c for _, c in got)
    for b, c in got:
        assert abs(sized.where(F.col("h") < c).agg(F.sum("size")).first()[0] - b) <= 50


# 10

def test_flac_round_trip(spark, docs, empty):
    src = docs.collect()
    out = flac.round_trip(docs).collect()
    assert len(out) == len(src)
    text = {r.doc_id: r.text for r in src}
    for r in out:
        n, p = flac.payload(text[r.doc_id])
        assert len(p) % 192 == 0 and p.startswith((text[r.doc_id] or "").encode()) and p[n:].strip(b" ") == b""
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(p), sha(p), zlib.crc32(p[-16:]))
    assert len({(r.media_sha256, r.feature) for r in out if text[r.doc_id] in (None, "")}) == 1
    assert flac.round_trip(empty).count() == 0
    blocks = flac.decode_column(flac.encode_column(docs), 100).where("doc_id = 75").orderBy("sample_offset").collect()
    assert b"".join(bytes(b.pcm) for b in blocks) == flac.payload(text[75])[1]
    assert [b.sample_offset for b in blocks] == list(range(0, len(flac.payload(text[75])[1]), 100))


def test_flac_forms_and_damage():
    rng = np.random.default_rng(0)
    wave = (128 + 90 * np.sin(np.arange(192 * 30) / 9) + rng.normal(0, 1, 192 * 30)).astype(np.uint8).tobytes()
    payloads = [bytes([v]) * 192 * 3 for v in (0, 255, 128)] + [rng.integers(0, 256, 192 * 9, dtype=np.uint8).tobytes(), wave, (wave[:192] + b"\x80" * 192) * 70]
    streams = flac.encode(payloads)
    assert flac.decode(streams) == payloads
    assert len(streams[4]) < len(wave)
    for at in (len(streams[4]) - 40, 60, 30):
        bad = bytearray(streams[4])
        bad[at] ^= 16
        try:
            assert flac.decode([bytes(bad)])[0] == wave  # bits that carry no data, such as a seek point's spare field
        except flac.Corrupt:
            pass
    bad = bytearray(streams[4])
    bad[-40] ^= 16
    with pytest.raises(flac.Corrupt):
        flac.decode([bytes(bad)])
    with pytest.raises(flac.Corrupt):
        flac.decode([b"RIFF" + streams[0]])


def test_flac_without_seek_table():
    """A reader needs no seek table: one lane then decodes frame after frame."""
    p = bytes(range(192)) * 300
    s = flac.encode([p])[0]
    total, md5, seek, first = flac._head(s)
    bare = b"fLaC\x80" + s[5:42] + s[first:]
    assert flac.decode([bare]) == [p]


def test_frame_numbers():
    for n in (0, 127, 128, 2047, 2048, 65535, 65536, 2**21 - 1, 2**21):
        b = flac._number(n)
        assert b == chr(n).encode("utf-8", "surrogatepass") if n < 0x110000 else len(b) == (4 if n < 2**21 else 5)


# shared

def test_tables_go_to_the_shared_folder(spark):
    df = common.written(spark.range(3), "test")
    assert common.shared_dir(spark) in df.inputFiles()[0].replace("file:///", "file:///") or df.inputFiles()[0].startswith("file:")
    assert df.count() == 3
    common.dropped(df)
