"""The pN_ queries: each applies a problem's operator to its whole tables."""

from __future__ import annotations

from lexiloom.llm import encoding, linking, nearcopies, packing, quality, repetition, sentences, spam, spans
from lexiloom.session import table


def p1_found(spark, d):
    return sentences.scoped_units(table(spark, d, "documents"), table(spark, d, "sentence_scope"))


def p1_units(spark, d):
    return sentences.sentence_units(table(spark, d, "documents"))


def p2_found(spark, d):
    return quality.not_prose(table(spark, d, "documents"), table(spark, d, "common_words"))


def p2_stats(spark, d):
    return quality.make_up(table(spark, d, "documents"), table(spark, d, "common_words"))


def p3_found(spark, d):
    return nearcopies.near_pairs(table(spark, d, "documents"))


def p3_groups(spark, d):
    return nearcopies.near_groups(table(spark, d, "documents"))


def p4_found(spark, d):
    return spans.shared_runs(table(spark, d, "documents"), table(spark, d, "sentence_matches"))


def p4_share(spark, d):
    return spans.shared_share(table(spark, d, "documents"), recorded=table(spark, d, "sentence_matches"))


def p5_found(spark, d):
    return repetition.repetitive(table(spark, d, "documents"))


def p5_repetition(spark, d):
    return repetition.repetition(table(spark, d, "documents"))


def p6_found(spark, d):
    return linking.groups(table(spark, d, "similar_pairs"))


def p7_ids(spark, d):
    return encoding.token_ids(table(spark, d, "documents"))


def p8_packed(spark, d):
    return packing.packed(encoding.token_counts(table(spark, d, "documents")), table(spark, d, "pack_limits"))


def p8_fill(spark, d):
    limits = table(spark, d, "pack_limits")
    return packing.fill(p8_packed(spark, d), limits)


def p9_found(spark, d):
    return spam.spam_pages(table(spark, d, "documents"), table(spark, d, "common_words"))


def p9_distances(spark, d):
    return spam.judged(table(spark, d, "documents"), table(spark, d, "common_words"))


def queries():
    return {f.__name__: f for f in (p1_found, p1_units, p2_found, p2_stats, p3_found, p3_groups, p4_found, p4_share, p5_found, p5_repetition, p6_found, p7_ids, p8_packed, p8_fill, p9_found, p9_distances)}


_FORM = r"(select doc_id, regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]', '', 'g') as f from documents)"


def oracle_sql():
    """Brute force in SQL, where that ends in time on the small data."""
    shingles = f"(select distinct doc_id, substr(f, i, 12) as g from (select doc_id, f, unnest(range(1, length(f) - 10)) as i from {_FORM} where length(f) >= 200))"
    windows = "(select doc_id, i, hash(substr(text, i, 200)) as h from (select doc_id, text, unnest(range(1, length(text) - 198)) as i from documents where length(text) >= 200))"
    out = {
        "p3_found": f"""with s as materialized (select * from {shingles}), n as (select doc_id, count(*) as n from s group by doc_id), ab as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all)
            select a as doc_a, b as doc_b from ab join n x on x.doc_id = a join n y on y.doc_id = b where c >= 0.5 * (x.n + y.n - c)""",
        "p4_found": f"""with w as materialized (select * from {windows}), hit as (select doc_id, i from w where h in (select h from w group by h having count(distinct doc_id) > 1)),
            e as (select doc_id, i, case when i > lag(i) over (partition by doc_id order by i) + 200 then 1 else 0 end as new from hit), r as (select doc_id, i, sum(new) over (partition by doc_id order by i) as run from e)
            select doc_id, min(i) - 1 as start_pos, max(i) + 199 as end_pos from r group by doc_id, run""",
        "p5_found": f"""with g as (select doc_id, length(f) as n, i, row_number() over (partition by doc_id, substr(f, i, 20) order by i) as k from (select doc_id, f, unnest(range(1, length(f) - 18)) as i from {_FORM} where length(f) >= 20)),
            p as (select distinct doc_id, n, unnest(range(i, i + 20)) as pos from g where k > 1) select doc_id from p group by doc_id, n having count(*) >= 0.3 * n""",
        "p6_found": """with recursive e as (select distinct doc_a as u, doc_b as v from similar_pairs where pct >= 60 and doc_a <> doc_b union select doc_b, doc_a from similar_pairs where pct >= 60 and doc_a <> doc_b),
            r(name, other) as (select u, u from e union select r.name, e.v from r join e on r.other = e.u) select name as doc_name, min(other) as group_name from r group by name""",
    }
    out["p3_groups"] = f"""with recursive f as (select * from {_FORM} where length(f) >= 200), c as materialized (select doc_id, min(doc_id) over (partition by f) as class_id from f),
            pr as materialized ({out["p3_found"]}), e as materialized (select distinct a.class_id as u, b.class_id as v from (select doc_a as x, doc_b as y from pr union all select doc_b, doc_a from pr) join c a on a.doc_id = x join c b on b.doc_id = y where a.class_id <> b.class_id),
            r(u, v) as (select u, u from e union select r.u, e.v from r join e on r.v = e.u)
            select doc_id, class_id, coalesce(g, class_id) as group_id, coalesce(n, 0) as links from c left join (select u, min(v) as g from r group by u) x on x.u = class_id left join (select u, count(*) as n from e group by u) y on y.u = class_id"""
    out["p4_share"] = f"""select doc_id, n_chars, coalesce(s, 0)::bigint as shared_chars, case when n_chars > 0 then coalesce(s, 0)::double / n_chars else 0.0 end as shared_share, coalesce(n, 0) as runs
            from (select doc_id, coalesce(length(text), 0)::bigint as n_chars from documents) left join (select doc_id, sum(end_pos - start_pos) as s, count(*) as n from ({out["p4_found"]}) group by doc_id) using (doc_id)"""
    return out
