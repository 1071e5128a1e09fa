"""DuckDB SQL for the queries of this package that SQL expresses in reasonable time.

The others learn a model, align texts, or pack sequences; their tests compare them with brute force.
"""

from __future__ import annotations

TWINS = {
    "op10_embedding_near_dedup": """
        with recursive v as (
            select vec_id, label, embedding::double[] as e from embeddings
        ), usable as (
            select vec_id, label, e, sqrt(list_dot_product(e, e)) as size from v
            where label is not null and e is not null
              and len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0
              and len(list_filter(e, lambda x: x <> 0)) > 0
        ), links as (
            select a.vec_id as a, b.vec_id as b from usable a join usable b
              on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
            where list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.98
        ), reach(a, b) as (
            select vec_id, vec_id from v union select r.a, l.b from reach r join links l on r.b = l.a
        ), component as (
            select a as vec_id, min(b) as component_id from reach group by a
        ), counted as (
            select a as vec_id, count(*) as n_links from links group by a
        )
        select v.vec_id, coalesce(n_links, 0)::bigint as n_links, component_id,
               v.vec_id = component_id as kept
        from v left join counted using (vec_id) left join component using (vec_id)
    """,
    "op12_lexical_search": r"""
        with words as (
            select row_number() over () as r, doc_id,
                   regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w
            from documents
        ), sizes as (
            select r, doc_id, len(w)::bigint as n from words where len(w) > 0
        ), totals as (
            select count(*)::bigint as docs, sum(n)::bigint as length from sizes
        ), tf as (
            select r, term, count(*)::bigint as tf from (select r, unnest(w) as term from words) group by all
        ), df as (
            select term, count(*)::bigint as df from tf group by term
        ), weights as (
            select term, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)::double))::bigint as w from df, totals
        ), asked as (
            select item_id, unnest(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
            from benchmark
        ), counted as (
            select item_id, term, count(*)::bigint as q from asked group by all
        ), scored as (
            select item_id, r,
                   sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // length))))::bigint as score
            from counted join weights using (term) join tf using (term) join sizes using (r), totals
            group by all
        ), ranked as (
            select item_id, doc_id, score,
                   row_number() over (partition by item_id order by score desc, doc_id)::int as rank
            from scored join sizes using (r) where score > 0
        )
        select item_id, rank, doc_id, score from ranked where rank <= 10
    """,
}
