"""SQL (DuckDB) for the training-data queries that SQL can express, written apart from the operators."""

from __future__ import annotations

from lumenweft.llm.license_scan import PHRASES, TEMPLATES, THRESHOLD, needed, stride
from lumenweft.llm.source_mix import MOST, RAMPS, WEIGHTS

LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def license_scan() -> str:
    """Every block of every size against every template, and every word position against every phrase."""
    tables = ", ".join(f"('{k}', {_list(sorted(set(v.split())))}, {needed(v, THRESHOLD)}, {stride(v)})" for k, v in TEMPLATES.items())
    phrases = ", ".join(f"('{v}', {_list(k.split())})" for k, v in PHRASES.items())
    return rf"""
    with t(label, words, need, stride) as (values {tables}), p(label, words) as (values {phrases}),
    d as (select row_number() over () rid, doc_id, {LOW} low from documents),
    w as (select rid, doc_id, regexp_extract_all(low, '{WORDS}') ws from d),
    one as (select rid, i - 1 pos, ws[i] word from (select rid, ws, unnest(range(1, len(ws) + 1)) i from w)),
    tw as (select label, len(words) size, need, stride, unnest(words) word from t),
    inside as (select rid, label, size, need, word, pos // stride - back k from one join tw using (word), (values (0), (1)) b(back)),
    hits as (select rid, label, count(distinct word) / any_value(size)::double score from inside where k >= 0 group by rid, label, k having count(distinct word) >= any_value(need)),
    places as (select rid, label, i - 1 pos from (select rid, ws, unnest(range(1, len(ws) + 1)) i from w), p where ws[i] = words[1] and ws[i : i + len(words) - 1] = words),
    b as (select rid, count(*) n, min(pos) lo, max(pos) hi, string_agg(distinct label, ',' order by label) labels from places group by rid),
    a as (select rid, string_agg(distinct label, ',' order by label) labels from (select rid, label from hits union all select rid, label from places) group by rid),
    s as (select rid, max(score) score from hits group by rid)
    select w.doc_id, len(ws)::bigint n_words, coalesce(b.n, 0)::bigint n_base, lo::bigint first_word, hi::bigint last_word,
           coalesce(b.labels, '') base_labels, coalesce(a.labels, '') labels, coalesce(s.score, 0.0)::double score
    from w left join b using (rid) left join a using (rid) left join s using (rid)
    """


EXACT_TOPK = """
    with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) v from embeddings
               where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    s as (select q.vec_id query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint score from v q join v c on q.vec_id != c.vec_id and len(q.v) = len(c.v) where q.vec_id % 50 = 0)
    select query_id, rank::int rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from s) where rank <= 5
"""

SPACED = r"[^\x20\x09-\x0D]+"

#: Every window against every other one, by its words' md5; the words left are joined again.
SUBSTRING_DEDUP = rf"""
    with d as (select row_number() over () rid, doc_id, regexp_extract_all(coalesce(text, ''), '{SPACED}') ws from documents),
    p as (select rid, i, md5(array_to_string(ws[i : i + 34], ' ')) h from (select rid, ws, unnest(range(1, len(ws) - 33)) i from d)),
    r as (select rid, i from p where h in (select h from p group by h having count(*) > 1)),
    gone as (select distinct rid, i + k as i from r, (select unnest(range(35)) k)),
    w as (select rid, i, ws[i] w from (select rid, ws, unnest(range(1, len(ws) + 1)) i from d)),
    kept as (select rid, string_agg(w, ' ' order by i) t, count(*) n from w anti join gone using (rid, i) group by rid)
    select doc_id, len(ws)::bigint n_words, (len(ws) - coalesce(n, 0))::bigint n_removed, sha256(coalesce(t, '')) kept_sha256 from d left join kept using (rid)
"""

#: Sums over all sources and words, in one order per source; the first position solves the integral of the source's schedule for the share met by then.
SOURCE_MIX = rf"""
    with d as (select row_number() over () rid, doc_id, source, coalesce(len(regexp_extract_all(text, '{SPACED}')), 0)::bigint size,
                      md5(coalesce(doc_id::varchar, '') || ':' || coalesce(text, '')) place from documents),
    s as (select source, sum(size)::bigint source_size, [5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1] weight from d group by source),
    c as (select *, {MOST} * source_size cap, (({MOST} * source_size) / weight)::double full_at from s),
    o as (select *, row_number() over (order by full_at, source nulls last) k from c),
    l as (select *, (sum(source_size) over () - coalesce(sum(cap) over (order by k rows between unbounded preceding and 1 preceding), 0))::double
                    / (sum(weight) over (order by k rows between current row and unbounded following))::double as level from o),
    cut as (select min(k) k, arg_min(level, k) level from l where level <= full_at),
    t as (select source, source_size, weight, case when l.k < cut.k then cap::double else cut.level * weight end target from l, cut),
    b as (select d.*, weight, source_size, target, coalesce(sum(size) over (partition by d.source order by place, rid rows between unbounded preceding and 1 preceding), 0)::double + size::double / 2 middle
          from d join t on d.source is not distinct from t.source),
    n as (select *, floor(target / source_size) passes from b),
    k as (select *, case when size = 0 then 0 else least({MOST}, passes::bigint + (middle <= target - passes * source_size)::bigint) end::int copies, middle / target share from n)
    select doc_id, size, source_size, target, (size * copies)::bigint taken, copies,
           case when copies > 0 then 2 * share / (a + sqrt(a * a + 2 * (b - a) * share)) end first_position
    from k join (values {', '.join(f'({w}, {a}::double, {b}::double)' for w, (a, b) in zip(WEIGHTS, RAMPS))}) r(weight, a, b) using (weight)
"""

#: Sets against sets by their common shingles; components by what a link reaches.
NEAR_DUPLICATES = rf"""
    with recursive d as (select row_number() over () rid, doc_id, regexp_extract_all({LOW}, '{SPACED}') ws from documents),
    s as (select rid, doc_id, list_sort(case when len(ws) < 2 then ws else list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) end) g from d),
    u as (select g, min(rid) c from s where len(g) > 0 group by g),
    e as (select c, len(g) n, unnest(g) v from u),
    p as (select a.c a, b.c b, count(*) shared, any_value(a.n) na, any_value(b.n) nb from e a join e b on a.v = b.v and a.c < b.c and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) group by 1, 2),
    l as (select a, b from p where 100 * shared >= 80 * (na + nb - shared)),
    near as (select a, b from l union all select b, a from l),
    reach(node, root) as (select c, c from u union select b, root from reach join near on node = a where root < b),
    roots as (select node, min(root) root from reach group by node),
    m as (select rid, doc_id, len(s.g) n, root from s left join u on s.g = u.g left join roots on node = c),
    f as (select root, min(doc_id) least_id from m where root is not null group by root)
    select doc_id, n::bigint n_shingles, case when root is null then doc_id else least_id end component_id, doc_id is not distinct from component_id kept from m left join f using (root)
"""


def oracles() -> dict[str, str]:
    return {"op2_substring_dedup": SUBSTRING_DEDUP, "op3_license_scan": license_scan(), "op4_exact_topk": EXACT_TOPK, "op6_source_mix": SOURCE_MIX, "op7_minhash_dedup": NEAR_DUPLICATES}
