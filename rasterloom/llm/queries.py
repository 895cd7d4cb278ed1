"""Queries and SQL of the operators in this subpackage, for __spark_entry__."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import common, flac, jaccard, language_id, licenses, lines, mixing, quality, sentence_pieces, suffixes, token_counts

#: The tokenizer of the token count and SentencePiece queries.
MODEL = "piece_bpe_32k.model"


def _docs(spark, sf_dir):
    common.bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op9_mixing(spark, sf_dir):
    return mixing.mix(_docs(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op1_language_id(spark, sf_dir):
    return language_id.language_id(_docs(spark, sf_dir))


def op3_license_scan(spark, sf_dir):
    return licenses.scan(_docs(spark, sf_dir), licenses.known(spark), of_lines=True)


def op4_quality(spark, sf_dir):
    out = quality.judged(_docs(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("distance2", 6).alias("distance2"))


def op5_line_dedup(spark, sf_dir):
    out = lines.dedup_lines(_docs(spark, sf_dir).select("doc_id", "text"), min_docs=10, least=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_token_counts(spark, sf_dir):
    # A cache of its own, so that each call encodes the whole table.
    return token_counts.token_counts(_docs(spark, sf_dir), public_tokenizers.path(MODEL), common.new_path(spark, "token-cache"))


def op6_jaccard_join(spark, sf_dir):
    return jaccard.near_duplicates(_docs(spark, sf_dir), percent=80, words=5)


def op7_suffix_dedup(spark, sf_dir):
    out = suffixes.remove_repeats(_docs(spark, sf_dir), length=100)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_sentence_pieces(spark, sf_dir):
    return sentence_pieces.encode_decode(_docs(spark, sf_dir), public_tokenizers.path(MODEL), digests=True)


def op10_flac(spark, sf_dir):
    return flac.round_trip(_docs(spark, sf_dir))


def queries():
    return {
        "op1_language_id": op1_language_id,
        "op2_token_counts": op2_token_counts,
        "op3_license_scan": op3_license_scan,
        "op4_quality": op4_quality,
        "op5_line_dedup": op5_line_dedup,
        "op6_jaccard_join": op6_jaccard_join,
        "op7_suffix_dedup": op7_suffix_dedup,
        "op8_sentence_pieces": op8_sentence_pieces,
        "op9_mixing": op9_mixing,
        "op10_flac": op10_flac,
    }


OP9_SQL = r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 8))::bigint >> 2 as h from documents),
s as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as k from d group by source),
c as (select *, [3.0, 1.0, 2.0][k % 3 + 1]::double as w, (2 * source_size)::double as cap from s),
r as (select *, cap / w as r from c),
l as (select *, (1.5::double * sum(source_size) over () - coalesce(sum(cap) over (order by r, source nulls last rows between unbounded preceding and 1 preceding), 0))
    / sum(w) over (order by r, source nulls last rows between current row and unbounded following) as level from r),
g as (select source, source_size, case when level > r then cap else least(cap, w * max(case when level <= r then level end) over ()) end as target from l),
b as (select *, case when source_size > 0 then floor(target / source_size) else 0 end::bigint as whole from g),
e as (select *, target - whole * source_size as budget from b),
x as (select d.source, h, sum(size)::bigint as n from d group by all),
u as (select source, h, n, sum(n) over (partition by source order by h) as upto from x),
m as (select e.source, arg_max(struct_pack(h := u.h, under := upto - n, upto := upto), u.h) as t, any_value(budget) as budget
    from u join e on u.source is not distinct from e.source where budget > 0 and upto - n <= budget group by e.source),
t as (select source, t.h + case when t.upto - budget <= budget - t.under then 1 else 0 end as cut from m)
select d.doc_id, d.size, e.source_size, e.target, (least(2, e.whole + case when d.h < coalesce(t.cut, 0) then 1 else 0 end) * d.size)::bigint as taken
from d join e on d.source is not distinct from e.source left join t on d.source is not distinct from t.source
"""


def _canonical_sql(text: str) -> str:
    t = f"regexp_replace(lower(coalesce({text}, '')), '(?m){licenses.NOTICE}', ' ', 'g')"
    t = rf"' ' || regexp_replace({t}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', '  ', 'g') || ' '"
    for old, new in licenses.SPELLINGS:
        t = f"replace({t}, ' {old.replace(' ', '  ')} ', ' {new.replace(' ', '  ')} ')"
    return f"sha256(trim(regexp_replace({t}, ' +', ' ', 'g'), ' '))"


def _op3_sql() -> str:
    rows = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in licenses.forms())
    return f"""
with k as (select {_canonical_sql("text")} as digest, min(id) as license_id from (values {rows}) v(id, text) group by 1),
d as (select doc_id, text, {_canonical_sql("text")} as digest from documents),
l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line from documents),
n as (select doc_id, count(*) as n from l where {_canonical_sql("line")} in (select digest from k) group by doc_id)
select d.doc_id, d.digest as canonical_sha256, k.license_id, coalesce(n.n, 0)::bigint as n_license_lines
from d left join k on k.digest = d.digest left join n on n.doc_id = d.doc_id
"""


OP5_SQL = r"""
with t as (select row_number() over () as row, doc_id, coalesce(text, '') as text from documents),
l as (select row, doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from t),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
b as (select key from k where key <> '' group by key having count(distinct row) >= 10)
select doc_id, count(*)::bigint as n_lines, count(*) filter (where bad)::bigint as n_dropped,
    sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not bad), '')) as kept_sha256
from (select k.*, key in (select key from b) as bad from k) group by row, doc_id
"""


OP6_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, case when len(w) < 5 then array_to_string(w, ' ') else array_to_string(w[i : i + 4], ' ') end as s
    from (select doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.s = b.s and a.doc_id <> b.doc_id group by all),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
r as (select doc_id as a, doc_id as b from documents union select r.a, l.b from r join l on l.a = r.b)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, m.c as component_id
from documents d left join n on n.doc_id = d.doc_id join (select a, min(b) as c from r group by a) m on m.a = d.doc_id
"""


OP7_SQL = r"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) as x, strlen(coalesce(text, '')) as n from documents),
w as (select doc_id, i, md5(substr(x, 2 * i + 1, 200)) as k from (select doc_id, x, unnest(range(0, greatest(n - 99, 0))) as i from d)),
f as (select k, min(struct_pack(doc_id := doc_id, i := i)) as f from w group by k having count(*) > 1),
g as (select w.doc_id, w.i from w join f on f.k = w.k where (w.doc_id, w.i) <> (f.f.doc_id, f.f.i)),
b as (select d.doc_id, d.x, unnest(range(0, d.n)) as b from d where d.doc_id in (select doc_id from g)),
c as (select b.doc_id, b.b, substr(b.x, 2 * b.b + 1, 2) as x,
    max(g.i) over (partition by b.doc_id order by b.b rows between 99 preceding and current row) is not null as gone
    from b left join g on g.doc_id = b.doc_id and g.i = b.b),
s as (select *, gone and not coalesce(lag(gone) over (partition by doc_id order by b), false) as starts from c),
r as (select doc_id, count(*) filter (where gone) as n_removed, count(*) filter (where starts) as n_spans,
    sha256(unhex(coalesce(string_agg(x, '' order by b) filter (where not gone), ''))) as kept_sha256 from s group by doc_id)
select d.doc_id, d.n::bigint as n_bytes, coalesce(r.n_removed, 0)::bigint as n_removed, coalesce(r.n_spans, 0)::bigint as n_spans,
    coalesce(r.kept_sha256, sha256(unhex(d.x))) as kept_sha256
from d left join r on r.doc_id = d.doc_id
"""


def oracle_sql():
    return {"op3_license_scan": _op3_sql(), "op5_line_dedup": OP5_SQL, "op6_jaccard_join": OP6_SQL, "op7_suffix_dedup": OP7_SQL, "op9_mixing": OP9_SQL}
