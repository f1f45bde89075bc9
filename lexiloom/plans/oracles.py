"""The registered queries as SQL for DuckDB, written apart from the DataFrame expressions, to check their results."""

from __future__ import annotations

from lexiloom.functions import lexicon

# White space of the published behaviour, as a class of RE2.
SPACE = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
D = "(select doc_id, coalesce(text, '') as t from documents)"
CHECKS = "(select check_id, min(s).a as a, min(s).b as b from (select check_id, {'a': coalesce(submission, ''), 'b': coalesce(reference, '')} as s from single_checks) group by check_id)"
C = "(ln(1.5) + 1)"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rnd(x: str, d: int) -> str:
    return f"(floor(({x}) * 1e{d}::double + 0.5) / 1e{d}::double)"


def pct(x: str) -> str:
    return f"floor(({x}) * 100 + 0.5)::bigint"


def words(x: str, keep: str, least: int) -> str:
    return f"list_filter(string_split_regex(regexp_replace(lower({x}), '[^{keep}\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) >= {least})"


def tokens_all(x: str) -> str:
    return words(x, "a-z0-9", 1)


def tokens_style(x: str) -> str:
    return words(x, "a-z0-9''", 1)


def tokens_letters(x: str) -> str:
    return words(x, "a-z", 3)


STOP = "[" + ", ".join(q(w) for w in sorted(lexicon.STOP_WORDS)) + "]"


def tokens_content(x: str) -> str:
    return f"list_filter({words(x, 'a-z0-9', 3)}, lambda w: not list_contains({STOP}, w))"


def trimmed(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+\\z', '', 'g')"


def lexical(x: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({x}, '[^.!?\\n]+(?:[.!?]+|\\z)'), lambda s: {trimmed('s')}), lambda s: length(s) > 15 and len(string_split_regex(s, '{SPACE}+')) >= 4)"


def style(x: str) -> str:
    cut = f"regexp_replace({trimmed(x)}, '([.!?]){SPACE}+', '\\1' || chr(1114109), 'g')"
    return f"list_filter(string_split({cut}, chr(1114109)), lambda s: len(string_split_regex(s, '{SPACE}+')) >= 3)"


def boilerplate(s: str) -> str:
    return "(" + " or ".join(f"contains(lower({s}), {q(p)})" for p in lexicon.BOILERPLATE) + ")"


def grams(t: str, n: int) -> str:
    return f"list_transform(range(1, greatest(len({t}) - {n - 2}, 1)), lambda i: array_to_string(list_slice({t}, i, i + {n - 1}), ' '))"


def chars(s: str, n: int) -> str:
    return f"list_transform(range(1, greatest(length({s}) - {n - 2}, 1)), lambda i: substr({s}, i, {n}))"


def plain(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^a-z0-9]', '', 'g')"


def spaced(x: str) -> str:
    return f"regexp_replace(regexp_replace(lower({x}), '{SPACE}+', ' ', 'g'), '[^a-z0-9 ]', '', 'g')"


def lex_chunks(x: str) -> str:
    kept = f"list_filter({lexical(x)}, lambda z: not {boilerplate('z')})"
    return f"(select case when len(k) = 0 then [{x}] else list_transform(list_filter(range(1, len(k) + 1, 2), lambda i: i = 1 or len(k) - i >= 1), lambda i: array_to_string(list_slice(k, i, i + 3), ' ')) end from (select {kept} as k))"


CANON = "map {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in sorted(lexicon.canonical_words().items()) if " " not in k) + "}"


def canonical(x: str) -> str:
    return f"list_transform({tokens_letters(x)}, lambda w: coalesce({CANON}[w], w))"


def unnest(select: str, lists: str, source: str) -> str:
    """Rows (select, idx from 0, unit) of a list in each row of a source."""
    return f"(select {select}, unnest(range(0, len(l))) as idx, unnest(l) as unit from (select {select}, {lists} as l from {source}))"


def stats_sql() -> str:
    w = f"list_filter(string_split_regex({trimmed('t')}, '{SPACE}+'), lambda x: length(x) > 0)"
    return f"""select doc_id, len(w)::bigint as words, len(s)::bigint as sentences, length(regexp_replace(t, '{SPACE}', '', 'g'))::bigint as chars, u::bigint as unique_words,
        {rnd("u::double / greatest(len(w), 1)", 3)} as diversity, {rnd("len(w)::double / greatest(len(s), 1)", 1)} as avg_sentence, greatest(1, ceil(len(w) / 200.0))::bigint as minutes
        from (select *, len(list_distinct(list_transform(w, lambda x: lower(x)))) as u from (select doc_id, t, {w} as w, {lexical('t')} as s from {D}))"""


def postings(source: str, keys: str, tokens: str) -> str:
    """keys, term, tf, n, u, sq of each unit."""
    return f"""(select {keys}, term, tf, sum(tf) over w as n, count(*) over w as u, sum((tf * tf)::double) over w / (sum(tf) over w * sum(tf) over w)::double as sq
        from (select {keys}, term, count(*) as tf from (select {keys}, unnest({tokens}) as term from {source}) group by all) window w as (partition by {keys}))"""


def bm(tf: str, n: str) -> str:
    return f"ln(1 + 1 / ({tf}::double / {n} + 0.001)) * ({tf} * 2.5) / ({tf} + 1.5 * (1 - 0.75 + 0.75 * ({n} / ((a.n + b.n) / 2.0))))"


def scores(a: str, b: str, on: list[str], ka: list[str], kb: list[str], extra: str = "true") -> str:
    names = [*(f"a.{k}" for k in on + ka), *(f"b.{k}" for k in kb)]
    joins = " and ".join([f"a.{k} = b.{k}" for k in on] + ["a.term = b.term", extra])
    rest = f"max(a.sq) * {C} * {C} - ({C} * {C} - 1) * sum((a.tf::double / a.n) * (a.tf::double / a.n))", f"max(b.sq) * {C} * {C} - ({C} * {C} - 1) * sum((b.tf::double / b.n) * (b.tf::double / b.n))"
    return f"""(select {', '.join(names)}, least(sum((a.tf::double / a.n) * (b.tf::double / b.n)) / (sqrt({rest[0]}) * sqrt({rest[1]})), 1.0) as cosine,
        (least(sum({bm('b.tf', 'b.n')}) / (max(a.u) * 3), 1.0) + least(sum({bm('a.tf', 'a.n')}) / (max(b.u) * 3), 1.0)) / 2 as bm25
        from {a} a join {b} b on {joins} group by all)"""


def containment(a: str, b: str) -> str:
    """Of two gram lists named by expressions."""
    return f"(select case when len(x) = 0 then 0.0 else len(list_intersect(x, {b}))::double / len(x) end from (select list_distinct({a}) as x))"


def jaccard(a: str, b: str) -> str:
    return f"(select case when len(x) + len(y) = 0 then 0.0 else len(list_intersect(x, y))::double / (len(x) + len(y) - len(list_intersect(x, y))) end from (select list_distinct({a}) as x, list_distinct({b}) as y))"


def ordered_common(ga: str, gb: str) -> str:
    """Distinct elements of ga in gb, in the order of their first places in ga."""
    return f"(select coalesce(list(g order by p), []) from (select g, min(p) as p from (select unnest({ga}) as g, unnest(range(0, len({ga}))) as p) group by g) where list_contains({gb}, g))"


def joined(tokens: str) -> str:
    return f"select doc_id, len(x)::bigint as n, array_to_string(x, ' ') as tokens from (select doc_id, {tokens} as x from {D})"


PAIR_TOKENS = f"(select check_id, {tokens_content('a')} as ta, {tokens_content('b')} as tb, {tokens_all('a')} as xa, {tokens_all('b')} as xb from {CHECKS})"
COMBINED = "least(cosine * 0.30 + bm25 * 0.25 + bigram * 0.18 + trigram * 0.17 + fourgram * 0.10, 1.0)"
PAIR_ROWS = f"""(select g.check_id, coalesce(cosine, 0.0) as cosine, coalesce(bm25, 0.0) as bm25, bigram, trigram, fourgram
    from (select check_id, {containment(grams('ta', 2), grams('tb', 2))} as bigram, {containment(grams('ta', 3), grams('tb', 3))} as trigram, {containment(grams('xa', 4), grams('xb', 4))} as fourgram from {PAIR_TOKENS}) g
    left join {scores(postings(CHECKS, 'check_id', tokens_content('a')), postings(CHECKS, 'check_id', tokens_content('b')), ['check_id'], [], [])} s on s.check_id = g.check_id)"""


def side(c: str, key: str, split: str, extra: str) -> str:
    units = unnest("check_id", split, f"(select check_id, {c} from {CHECKS})")
    return postings(f"(select check_id, idx as {key}, {tokens_content('unit')} as tk, unit from {units})", f"check_id, {key}", f"case when len(tk) >= 3 and {extra} then tk else [] end")


WINDOWS = f"""(select check_id, ia, arg_min(ib, (-score, ib)) as ib, max(score) as score from (select *, {rnd('0.5 * bm25 + 0.5 * cosine', 9)} as score
    from {scores(side('a', 'ia', lex_chunks('a'), 'true'), side('b', 'ib', lex_chunks('b'), 'true'), ['check_id'], ['ia'], ['ib'])}) group by check_id, ia)"""

TERM = f"(select doc_id, term, count(*) as cnt, count(*)::double / any_value(n) as tf from (select doc_id, unnest(x) as term, len(x) as n from (select doc_id, {tokens_content('t')} as x from {D})) group by all)"
TFIDF = f"(select a.doc_id, a.term, a.tf * (ln(((select count(*) from documents) + 1)::double / (df + 1)) + 1) as weight from {TERM} a join (select term, count(distinct doc_id) as df from {TERM} group by term) b on a.term = b.term)"


def cross_sql() -> str:
    content, every = f"(select doc_id, {tokens_content('t')} as x from {D})", f"(select doc_id, {tokens_all('t')} as x from {D})"
    p = postings(D, "doc_id", tokens_content("t"))
    base = scores(f"(select doc_id as q, * exclude (doc_id) from {p} where doc_id % 20 = 0)", f"(select doc_id as o, * exclude (doc_id) from {p})", [], ["q"], ["o"], "a.q <> b.o")
    overlaps = []
    for source, n, name in ((content, 2, "bigram"), (content, 3, "trigram"), (every, 4, "fourgram")):
        g = f"(select doc_id, unnest(g) as g, len(g) as n from (select doc_id, list_distinct({grams('x', n)}) as g from {source}))"
        overlaps.append(f"left join (select a.doc_id as q, b.doc_id as o, count(*)::double / any_value(a.n) as {name} from {g} a join {g} b on a.g = b.g and a.doc_id % 20 = 0 and a.doc_id <> b.doc_id group by all) using (q, o)")
    pairs = f"select q, o, {pct(rnd(COMBINED.replace('bigram', 'coalesce(bigram, 0)').replace('trigram', 'coalesce(trigram, 0)').replace('fourgram', 'coalesce(fourgram, 0)'), 9))} as pct from {base} {' '.join(overlaps)}"
    return f"""select d.doc_id, coalesce(links, 0) as links, best_id, coalesce(best_pct, 0) as best_pct from (select distinct doc_id from documents where doc_id % 20 = 0) d
        left join (select q, count(*) as links, arg_min(o, (-pct, o)) as best_id, max(pct) as best_pct from ({pairs}) where pct > 20 group by q) on q = d.doc_id"""


def base_oracles() -> dict[str, str]:
    out = {
        "text_stats": stats_sql(),
        "tokens_content": joined(tokens_content("t")),
        "tokens_all": joined(tokens_all("t")),
        "tokens_style": joined(tokens_style("t")),
        "tokens_canonical": f"select doc_id, len(x)::bigint as n, len(list_filter(list_zip(x, c), lambda p: p[1] <> p[2]))::bigint as changed, array_to_string(c, ' ') as tokens from (select doc_id, {tokens_letters('t')} as x, {canonical('t')} as c from {D})",
        "sentences_lexical": f"select doc_id, idx, unit from {unnest('doc_id', lexical('t'), D)}",
        "sentences_style": f"select doc_id, idx, unit from {unnest('doc_id', style('t'), D)}",
        "boilerplate_sentences": f"select doc_id, idx, unit from {unnest('doc_id', lexical('t'), D)} where {boilerplate('unit')}",
        "lexical_chunks": f"select doc_id, idx, unit from {unnest('doc_id', lex_chunks('t'), D)}",
        "ngram_counts": f"select doc_id, {', '.join(f'len(list_distinct({grams("x", n)}))::bigint as {name}' for n, name in ((2, 'bigrams'), (3, 'trigrams'), (4, 'fourgrams'), (5, 'fivegrams')))} from (select doc_id, {tokens_all('t')} as x from {D})",
        "char_grams": f"select doc_id, len(k)::bigint as kgrams, len(list_distinct(k))::bigint as distinct_kgrams, len(list_distinct(s))::bigint as distinct_spaced from (select doc_id, {chars('p', 5)} as k, {chars('z', 4)} as s from (select doc_id, {plain('t')} as p, {spaced('t')} as z from {D}))",
        "term_frequency": f"select doc_id, term, cnt, {rnd('tf', 6)} as tf from {TERM}",
        "document_frequency": f"select term, count(distinct doc_id) as df from {TERM} group by term",
        "tfidf_top_terms": f"select doc_id, rank, term, {rnd('w', 6)} as weight from (select *, row_number() over (partition by doc_id order by w desc, term) as rank from (select doc_id, term, {rnd('weight', 9)} as w from {TFIDF})) where rank <= 10",
        "corpus_cosine": f"""select q as doc_id, count(*) as links, arg_min(o, (-sim, o)) as best_id, max(sim) as best_sim from (
            select a.doc_id as q, b.doc_id as o, {rnd('least(sum(a.weight * b.weight) / (any_value(na.norm) * any_value(nb.norm)), 1.0)', 4)} as sim from w a join w b on a.term = b.term and a.doc_id % 20 = 0 and a.doc_id <> b.doc_id
            join norms na on na.doc_id = a.doc_id join norms nb on nb.doc_id = b.doc_id group by a.doc_id, b.doc_id) where sim > 0 group by q""",
        "pair_similarity": f"select check_id, {', '.join(f'{rnd(k, 4)} as {k}' for k in ('cosine', 'bm25', 'bigram', 'trigram', 'fourgram'))}, {rnd(COMBINED, 4)} as combined, {pct(rnd(COMBINED, 9))} as pct from {PAIR_ROWS}",
        "matching_phrases": f"select check_id, len(p)::bigint as n, array_to_string(p, ' | ') as phrases from (select check_id, list_slice(list_concat(m3, list_filter(m5, lambda z: not list_contains(m3, z))), 1, 25) as p from (select check_id, {ordered_common('g3a', 'g3b')} as m3, {ordered_common('g5a', 'g5b')} as m5 from (select check_id, {grams('xa', 3)} as g3a, {grams('xb', 3)} as g3b, {grams('xa', 5)} as g5a, {grams('xb', 5)} as g5b from {PAIR_TOKENS})))",
        "sentence_matches": f"""select check_id, index_a, arg_min(index_b, (-sim, index_b)) as index_b, {rnd('max(sim)', 4)} as similarity from (select *, {rnd('cosine', 9)} as sim
            from {scores(side('a', 'index_a', lexical('a'), f'not {boilerplate("unit")}'), side('b', 'index_b', lexical('b'), f'not {boilerplate("unit")}'), ['check_id'], ['index_a'], ['index_b'])}) group by check_id, index_a having max(sim) >= 0.45""",
        "window_matches": f"""select r.check_id, rank, ia as index_a, ib as index_b, r4 as score, {pct('score')} as pct, case when length(unit) > 160 then substr(unit, 1, 160) || '...' else unit end as preview
            from (select *, row_number() over (partition by check_id order by r4 desc, ia) as rank from (select *, {rnd('score', 4)} as r4 from {WINDOWS} where score > 0.35)) r
            join {unnest('check_id', lex_chunks('a'), CHECKS)} c on c.check_id = r.check_id and c.idx = ia where rank <= 15""",
        "window_overall": f"""select c.check_id, c.chunks, coalesce(matched, 0) as matched, {rnd('least(coalesce(total, 0) / c.chunks, 1.0)', 4)} as overall, coalesce(gaps, 0) as mosaic_gaps, coalesce(gaps, 0) >= 3 as mosaic
            from (select check_id, len({lex_chunks('a')})::bigint as chunks from {CHECKS}) c left join (
            select check_id, count(*) as matched, sum(score) as total, count(*) filter (where nxt - ia > 1 and {rnd('score', 4)} > 0.45 and {rnd('nscore', 4)} > 0.45) as gaps
            from (select *, lead(ia) over w as nxt, lead(score) over w as nscore from {WINDOWS} where score > 0.35 window w as (partition by check_id order by ia)) group by check_id) m on m.check_id = c.check_id""",
        "cross_document_links": cross_sql(),
    }
    out["corpus_cosine"] = f"with w as materialized (select * from {TFIDF}), norms as materialized (select doc_id, sqrt(sum(weight * weight)) as norm from w group by doc_id) " + out["corpus_cosine"]
    return out


SIG_TOKENS = f"(select doc_id, t, x, s, len(x) as n, len(s) as ns, map_values(list_histogram(x)) as c, list_transform(x, lambda w: length(w)) as wl, list_transform(s, lambda z: len(string_split_regex(z, '{SPACE}+'))) as sl, map_values(list_histogram(list_transform(s, lambda z: lower(string_split_regex(z, '{SPACE}+')[1])))) as st from (select doc_id, t, {tokens_style('t')} as x, {style('t')} as s from {D}))"
TRANSITIONS = " + ".join(f"len(regexp_extract_all(lower(t), '\\b{p}\\b'))" for p in lexicon.TRANSITIONS)
TOP10 = "list_sum(list_slice(list_reverse_sort(c), 1, 10))::double / n"
FOG = "0.4 * (n::double / ns + 100 * (len(list_filter(wl, lambda v: v > 7))::double / n))"
SIGNALS = f"""(select doc_id, t, n as tokens, ns as sentences, case when ns < 3 then 0.5 else least(list_stddev_pop(sl) / list_avg(sl), 1.5) / 1.5 end as burstiness, case when n = 0 then 0.0 else len(c)::double / n end as ttr,
    case when n = 0 then 0.0 else len(list_filter(c, lambda v: v = 1))::double / n end as hapax,
    case when n < 10 then 0.5 when len(c) <= 1 then 0.0 else -list_sum(list_transform(c, lambda v: v::double / n * log2(v::double / n))) / log2(len(c)) end as entropy,
    case when ns = 0 then 0.0 else least(({TRANSITIONS})::double / ns, 2.0) / 2 end as transition, case when n = 0 then 0.0 else list_avg(wl) end as word_length, case when n = 0 then 0.0 else (n * list_sum(list_transform(wl, lambda v: v * v)) - list_sum(wl) * list_sum(wl))::double / (n * n) end as word_length_var,
    case when n = 0 then 0.0 else len(list_filter(wl, lambda v: v > 8))::double / n end as long_words, case when ns < 4 then 0.0 else list_max(st)::double / ns end as repetition,
    case when ns = 0 or n = 0 then 0.5 else least(abs({FOG} - 13) / 8, 1.0) end as fog, case when n = 0 then 0.5 when {TOP10} > 0.28 then 0.65 when {TOP10} < 0.15 then 0.25 else 0.5 end as zipf,
    case when ns = 0 then 0.0 else least(len(list_filter(sl, lambda v: v >= 12 and v <= 28))::double / ns * 1.2, 1.0) end as uniformity from {SIG_TOKENS})"""
SIGNAL_NAMES = ("burstiness", "ttr", "hapax", "entropy", "transition", "word_length", "word_length_var", "long_words", "repetition", "fog", "zipf", "uniformity")
CURVE = f"(select doc_id, case when len(x) < 20 then null else least(list_var_pop(list_transform(range(1, len(x) - 8), lambda i: list_avg(list_slice(lp, i, i + 9)))) * 2.5, 3.5) end as curvature from (select doc_id, x, list_transform(x, lambda w: log2(h[w]::double / len(x) + 0.0001)) as lp from (select doc_id, x, list_histogram(x) as h from (select doc_id, {tokens_style('t')} as x from {D}))))"


def likelihood(c: str) -> str:
    return f"case when {c} is null then 0.0::double when {rnd(c, 9)} > 2.5 then 0.9 when {rnd(c, 9)} > 1.8 then 0.6 when {rnd(c, 9)} > 1.0 then 0.3 else 0.05 end"


def occurrences(p: str) -> str:
    return f"(length(lower(t)) - length(replace(lower(t), {q(p)}, ''))) / {len(p)}.0"


SIG_SCORES = f"(select doc_id, t, [{', '.join('(' + ' + '.join([occurrences(p) for p in ph] + [f'case when contains(lower(t), {q(p)}) then 0.5 else 0.0 end' for p in tr]) + ')::double' for _, ph, tr in lexicon.SIGNATURES)}] as s from {D})"
SIG_ROWS = f"(select doc_id, list_max(s) as top, list_sum(s) as total, list_position(s, list_max(s)) as pos from {SIG_SCORES})"
MARKED = f"(select doc_id, list_filter([{', '.join(q(p) for p in lexicon.MARKERS)}], lambda p: contains(lower(t), p)) as l from {D})"
STYLE = f"""(select s.doc_id, length(s.t) as chars, {rnd(f"least(least(greatest((1 - burstiness) * 0.04 + (1 - hapax) * 0.04 + transition * 0.15 + entropy * 0.20 + least(len(m.l) / 2.0, 1.0) * 0.10 + repetition * 0.05 + (1 - fog) * 0.05 + zipf * 0.05 + uniformity * 0.05 + {likelihood('c.curvature')} * 0.27, 0.0), 1.0) + case when conf > 0.4 then conf * 0.08 else 0.0 end, 1.0)", 9)} as f
    from {SIGNALS} s join {CURVE} c using (doc_id) join {MARKED} m using (doc_id) join (select doc_id, case when top > 0 and total >= 2 then {rnd('top / greatest(total, 1.0)', 3)} else 0.0 end as conf from {SIG_ROWS}) g using (doc_id))"""
VERDICT = "case when chars < 50 then 'Unknown' when f >= 0.70 then 'Likely AI-Generated' when f >= 0.45 then 'Mixed / Uncertain' when f >= 0.25 then 'Likely Human-Written' else 'Human-Written' end"
STYLE_ROWS = f"(select doc_id, case when chars < 50 then 0.0 else {rnd('f', 4)} end as score, case when chars < 50 then 0 else {pct('f')} end as pct, {VERDICT} as verdict, case when chars < 50 then 'Low' when f >= 0.25 and f < 0.70 then 'Medium Confidence' else 'High Confidence' end as certainty from {STYLE})"
CHUNK_UNITS = f"(select doc_id, unnest(list_transform(range(1, len(s), 2), lambda i: array_to_string(list_slice(s, i, i + 3), ' '))) as t from (select doc_id, {style('t')} as s from {D}) where len(s) >= 8)"
CHUNK_VECTORS = f"""(select doc_id, coalesce(list_sum(wl), 0)::double / greatest(n, 1) as awl, 0.39 * (n::double / greatest(ns, 1)) + 11.8 * (coalesce(list_sum(list_transform(wl, lambda v: greatest(1, floor(v / 3.0)))), 0)::double / greatest(n, 1)) - 15.59 as fk,
    case when n > 1 then 10000 * (list_sum(list_transform(c, lambda v: (v * v)::double)) - n) / (n::double * n) else 0.0 end as yk
    from (select doc_id, len(x) as n, ns, list_transform(x, lambda w: length(w)) as wl, map_values(list_histogram(x)) as c from (select doc_id, {tokens_style('t')} as x, len({style('t')}) as ns from {CHUNK_UNITS})))"""


def style_oracles() -> dict[str, str]:
    score = "least(sa / 2 * 0.3 + sf / 4 * 0.4 + sy / 100 * 0.3, 1.0)"
    rate = f"(length(t) - length(replace(t, ',', '')))::double / len(string_split_regex(t, '{SPACE}+'))"
    names = "[" + ", ".join(q(n) for n, _, _ in lexicon.SIGNATURES) + "]"
    return {
        "style_signals": f"select doc_id, tokens, sentences, {', '.join(f'{rnd(c, 3)} as {c}' for c in SIGNAL_NAMES)} from {SIGNALS}",
        "punctuation": f"select doc_id, {rnd(rate, 3)} as comma_rate, length(t) - length(replace(t, ';', '')) as semicolons, {rnd(f'least({rate} / 0.15, 1.0)', 3)} as comma_uniformity from {D}",
        "marker_phrases": f"select doc_id, len(l)::bigint as n, array_to_string(l, ' | ') as phrases from {MARKED}",
        "phrase_signatures": f"select doc_id, case when top > 0 and total >= 2 then {names}[pos] end as model, case when top > 0 and total >= 2 then {rnd('top / greatest(total, 1.0)', 3)} else 0.0 end as confidence, total from {SIG_ROWS}",
        "curvature": f"select doc_id, coalesce({rnd('curvature', 2)}, 0.0) as curvature, {likelihood('curvature')} as likelihood from {CURVE}",
        "style_variance": f"select d.doc_id, case when sa is null then 0.0 else {rnd(score, 3)} end as variance, sa is not null and {rnd(score, 9)} > 0.45 as multi_author, coalesce({rnd('my', 1)}, 0.0) as yules_k, {rnd('mf', 1)} as grade from documents d left join (select doc_id, stddev_pop(awl) as sa, stddev_pop(fk) as sf, stddev_pop(yk) as sy, avg(yk) as my, avg(fk) as mf from {CHUNK_VECTORS} group by doc_id) v on v.doc_id = d.doc_id",
        "machine_style": f"select doc_id, score, pct, verdict, certainty from {STYLE_ROWS}",
    }


# Codes of a text of a-z and 0-9, and the polynomial hashes of its 5-grams (below 2^63 before the modulus).
CODES = f"(select doc_id, p, list_transform(string_split(p, ''), lambda c: ascii(c)::bigint) as c, length(p) as n from (select doc_id, {plain('t')} as p from {D}))"
HASHED = "list_transform(range(1, greatest(n - 3, 1)), lambda i: ((((c[i] * 101 + c[i + 1]) * 101 + c[i + 2]) * 101 + c[i + 3]) * 101 + c[i + 4]) % 1000000007)"


def selected(source: str, key: str) -> str:
    """key, position, hash, gram of the winnowed fingerprints of rows (key, p, c, n)."""
    return f"""(select {key}, position, hash, substr(p, (position + list_position(list_slice(h, position + 1, position + 4), hash))::bigint, 5) as gram from (
            select {key}, hash, min(i) - 1 as position, any_value(p) as p, any_value(h) as h from (select {key}, p, h, i, list_min(list_slice(h, i, i + 3)) as hash from (select {key}, p, h, unnest(range(1, len(h) - 2)) as i from (select {key}, p, {HASHED} as h from {source}) where len(h) >= 4)) group by {key}, hash)
        union all select {key}, i - 1, h[i], substr(p, i, 5) from (select {key}, p, h, unnest(range(1, len(h) + 1)) as i from (select {key}, p, {HASHED} as h from {source}) where len(h) < 4))"""


def check_codes(c: str) -> str:
    return f"(select check_id, p, list_transform(string_split(p, ''), lambda z: ascii(z)::bigint) as c, length(p) as n from (select check_id, {plain(c)} as p from {CHECKS}))"


M32 = "4294967295::hugeint"


def fnv(w: str) -> str:
    return f"list_reduce(list_transform(string_split({w}, ''), lambda c: ascii(c)::hugeint), lambda h, c: (xor(h, c) * 16777619::hugeint) & {M32}, 2166136261::hugeint)"


def simhash_of(tokens: str) -> str:
    hs = f"list_transform(list_filter({tokens}, lambda w: length(w) > 2), lambda w: {fnv('w')})"
    return f"(select case when len(hs) = 0 then 0 else list_sum(list_transform(range(0, 32), lambda i: case when list_sum(list_transform(hs, lambda h: case when (h::bigint >> i::integer) & 1 = 1 then 1 else -1 end)) > 0 then (1::bigint << i::integer) else 0 end))::bigint end from (select {hs} as hs))"


def mixed(g: str) -> str:
    k1 = f"((c * 3432918353::hugeint) & {M32})"
    k2 = f"((((({k1} * 32768::hugeint) & {M32}) + ({k1} // 131072::hugeint)) * 461845907::hugeint) & {M32})"
    x = f"xor(h, {k2})"
    body = f"((((({x} * 8192::hugeint) & {M32}) + ({x} // 524288::hugeint)) * 5 + 3864292196::hugeint) & {M32})"
    folded = f"list_reduce(list_transform(string_split({g}, ''), lambda z: ascii(z)::hugeint), lambda h, c: {body}, 3735928559::hugeint)"
    return f"(select xor(y, y // 65536::hugeint) from (select (xor(y, y // 8192::hugeint) * 3266489909::hugeint) & {M32} as y from (select (xor(y, y // 65536::hugeint) * 2246822507::hugeint) & {M32} as y from (select xor({folded}, length({g})::hugeint) as y))))"


def coefficients() -> str:
    seed, rows = 0xDEADBEEF, []
    for i in range(128):
        seed = (seed * 1664525 + 1013904223) % 2**32
        a = seed % (2**31 - 1) + 1
        seed = (seed * 1664525 + 1013904223) % 2**32
        rows.append(f"({i}, {a}::double, {seed % (2**31 - 1)}::double)")
    return f"(select * from (values {', '.join(rows)}) v(i, a, b))"


def minhashes(source: str, key: str, tokens: str, n: int) -> str:
    """key, i, v of the texts (key, t) of a source."""
    g = f"(select {key}, unnest(list_distinct({grams('x', n)})) as g from (select {key}, {tokens} as x from {source}))"
    h = f"(select g, {mixed('g')}::double as x from (select distinct g from {g}))"
    return f"(select k.{key}, p.i, coalesce(m.v, 0.0) as v from (select distinct {key} from {source}) k cross join {coefficients()} p left join (select {key}, i, min((a * x + b) % 2147483647::double) as v from {g} join {h} using (g) cross join {coefficients()} group by {key}, i) m on m.{key} = k.{key} and m.i = p.i)"


def paragraphs(c: str) -> str:
    parts = f"list_filter(string_split_regex({c}, '\\n{{2,}}|\\r\\n{{2,}}'), lambda p: length({trimmed('p')}) > 30)"
    return f"(select check_id, idx, {simhash_of(tokens_all('unit'))} as h from {unnest('check_id', parts, CHECKS)})"


def estimated(n: int) -> str:
    return f"(select check_id, count(*) filter (where a.v = b.v) / 128.0::double as e from {minhashes(CHECKS, 'check_id', tokens_all('a'), n)} a join {minhashes(CHECKS, 'check_id', tokens_all('b'), n)} b using (check_id, i) group by check_id)"


def sketch_oracles() -> dict[str, str]:
    fa, fb = selected(check_codes("a"), "check_id"), selected(check_codes("b"), "check_id")
    sims = f"(select check_id, {simhash_of(tokens_all('a'))} as x, {simhash_of(tokens_all('b'))} as y from {CHECKS})"
    mh = "x.e * 0.55 + y.e * 0.45"
    return {
        "rabin_hashes": f"select doc_id, len(h)::bigint as grams, h[1] as first_hash, coalesce(list_sum(h), 0)::bigint as sum_hash, len(list_distinct(h))::bigint as distinct_hashes from (select doc_id, {HASHED} as h from {CODES})",
        "winnowed": f"select doc_id, position, hash, gram from {selected(CODES, 'doc_id')}",
        "fingerprint_compare": f"""with fa as materialized (select * from {fa}), fb as materialized (select * from {fb}), sa as (select check_id, list(distinct hash) as s from fa group by check_id), sb as (select check_id, list(distinct hash) as s from fb group by check_id),
            g as (select check_id, list(gram order by p) as l from (select fa.check_id, gram, min(position) as p from fa join sb on sb.check_id = fa.check_id and list_contains(sb.s, fa.hash) group by fa.check_id, gram) group by check_id)
            select check_id, {rnd('case when na + nb - i = 0 then 0.0 else i::double / (na + nb - i) end', 4)} as jaccard, {rnd('case when na = 0 then 0.0 else i::double / na end', 4)} as a_in_b, {rnd('case when nb = 0 then 0.0 else i::double / nb end', 4)} as b_in_a, na as size_a, nb as size_b, array_to_string(list_slice(l, 1, 30), ' ') as grams
            from (select c.check_id, len(coalesce(sa.s, [])) as na, len(coalesce(sb.s, [])) as nb, len(list_intersect(coalesce(sa.s, []), coalesce(sb.s, []))) as i, coalesce(g.l, []) as l from {CHECKS} c left join sa using (check_id) left join sb using (check_id) left join g using (check_id))""",
        "copied_blocks": f"select check_id, len(x)::bigint as n, array_to_string(x, ' ') as blocks from (select check_id, {ordered_common('ga', 'gb')} as x from (select check_id, {chars('pa', 8)} as ga, {chars('pb', 8)} as gb from (select check_id, {plain('a')} as pa, {plain('b')} as pb from {CHECKS})))",
        "simhash": f"select doc_id, {simhash_of(tokens_all('t'))} as simhash from {D}",
        "simhash_compare": f"select check_id, x as simhash_a, y as simhash_b, d as hamming, {rnd('1 - d / 32.0', 4)} as similarity, d <= 4 as near, {pct('1 - d / 32.0')} as pct from (select *, bit_count(xor(x, y))::bigint as d from {sims})",
        "near_paragraphs": f"select check_id, a.idx as index_a, b.idx as index_b, {rnd('1 - bit_count(xor(a.h, b.h)) / 32.0', 4)} as similarity from {paragraphs('a')} a join {paragraphs('b')} b using (check_id) where 1 - bit_count(xor(a.h, b.h)) / 32.0 >= 0.8",
        "minhash_values": f"select doc_id, i::bigint as permutation, v as value from {minhashes(D, 'doc_id', tokens_all('t'), 2)}",
        "minhash_compare": f"select check_id, {rnd('x.e', 4)} as bigram, {rnd('y.e', 4)} as trigram, {rnd(mh, 4)} as score, {pct(rnd(mh, 9))} as pct from {estimated(2)} x join {estimated(3)} y using (check_id)",
        "minhash_matrix": f"with m as materialized (select * from {minhashes(D, 'doc_id', tokens_all('t'), 2)}) select q as doc_id, count(*) as links, arg_min(o, (-n, o)) as best_id, {rnd('max(n) / 128.0', 4)} as best_sim from (select a.doc_id as q, b.doc_id as o, count(*) as n from m a join m b on a.i = b.i and a.v = b.v and a.doc_id % 20 = 0 and a.doc_id <> b.doc_id group by all) group by q",
    }


def paraphrase_oracles() -> dict[str, str]:
    sp = f"(select check_id, {spaced('a')} as a, {spaced('b')} as b from {CHECKS})"
    chars_of = ", ".join(f"{jaccard(chars('a', n), chars('b', n))} as c{n}" for n in (3, 4, 5))
    canon = f"(select check_id, {canonical('a')} as a, {canonical('b')} as b from {CHECKS})"
    first = lambda c: f"(select check_id, w, min(p) as p from (select check_id, unnest({c}) as w, unnest(range(0, len({c}))) as p from {canon}) group by all)"
    ranks = f"(select check_id, row_number() over (partition by check_id order by x.p) - row_number() over (partition by check_id order by y.p) as d from {first('a')} x join {first('b')} y using (check_id, w))"
    rho = f"(select check_id, greatest(0.0, least(1 - 6 * sum(d * d)::double / (count(*) * (count(*) * count(*) - 1)), 1.0)) as rho from {ranks} group by check_id having count(*) >= 4)"
    score = rnd("least((c3 + c4 + c5) / 3 * 0.35 + s * 0.40 + coalesce(rho, 0.0) * 0.25, 1.0)", 9)
    names = [(w, c, i, s) for w, c in lexicon.canonical_words().items() if " " not in w for i, s in enumerate(lexicon.synonym_groups()[c])]
    table = "(select * from (values " + ", ".join(f"({q(w)}, {q(c)}, {i}, {q(s)})" for w, c, i, s in names) + ") v(original, canonical, place, synonym))"
    lists = "map {" + ", ".join(f"{q(k)}: {q(' | '.join(v))}" for k, v in lexicon.synonym_groups().items()) + "}"
    return {
        "char_similarity": f"select check_id, {rnd('c3', 4)} as char3, {rnd('c4', 4)} as char4, {rnd('c5', 4)} as char5, {rnd('(c3 + c4 + c5) / 3', 4)} as mean from (select check_id, {chars_of} from {sp})",
        "synonym_overlap": f"select check_id, {rnd(jaccard('a', 'b'), 4)} as overlap from {canon}",
        "synonym_substitutions": f"""select check_id, rank, original, synonym, canonical from (select *, row_number() over (partition by check_id order by pos, place) as rank from (
            select check_id, original, min(p) as pos, any_value(tb) as tb from (select check_id, unnest(ta) as original, unnest(range(0, len(ta))) as p, tb from (select check_id, {tokens_letters('a')} as ta, {tokens_letters('b')} as tb from {CHECKS})) group by check_id, original)
            join {table} using (original) where original <> synonym and len(list_filter(string_split(synonym, ' '), lambda w: not list_contains(tb, w))) = 0) where rank <= 20""",
        "word_order": f"select check_id, {rnd('coalesce(rho, 0.0)', 4)} as rho from {CHECKS} left join {rho} using (check_id)",
        "paraphrase": f"select check_id, {rnd('x', 4)} as score, {pct('x')} as pct, case when x >= 0.55 then 'High Paraphrase Risk' when x >= 0.35 then 'Moderate Paraphrase Risk' else 'Low Paraphrase Risk' end as verdict from (select check_id, {score} as x from (select check_id, {chars_of} from {sp}) join (select check_id, {jaccard('a', 'b')} as s from {canon}) using (check_id) left join {rho} using (check_id))",
        "sentence_overlap": f"select match_id, {rnd('max(case when len(a) = 0 or len(b) = 0 then 0.0 else o end)', 4)} as overlap from (select match_id, a, b, {jaccard('a', 'b')} as o from (select match_id, {canonical(chr(99) + 'oalesce(sentence_a, ' + q('') + ')')} as a, {canonical(chr(99) + 'oalesce(sentence_b, ' + q('') + ')')} as b from sentence_matches)) group by match_id",
        "synonyms_of": f"select term as word, coalesce({CANON}[term], term) as canonical, coalesce({lists}[coalesce({CANON}[term], term)], '') as synonyms from (select distinct term from {TERM})",
    }


EXT = "lower(coalesce(ext, nullif(regexp_extract(name, '\\.([^./\\\\]+)$', 1), ''), ''))"
SNIPPETS = "(select source_id, coalesce(lower(trim(type)), 'unknown') as type, " + trimmed("regexp_replace(coalesce(snippet, ''), '<[^>]*>?', '', 'g')") + " as t from (select *, row_number() over (partition by url order by source_id) as r from source_rows) where r = 1)"
QUERIES = f"(select doc_id, idx as sample, array_to_string(list_slice({tokens_all('unit')}, 1, 7), ' ') as query from {unnest('doc_id', f'(select list_slice(list_filter(list_transform(range(0, len(l)), lambda i: case when i % greatest(1, len(l) // 8) = 0 then l[i + 1] end), lambda z: z is not null), 1, 8) from (select {lexical(chr(116))} as l))', D)})"
ONE = "(select doc_id, min(coalesce(text, '')) as t from documents group by doc_id)"
PLAIN_SENTENCE = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
RELATED = "(select name, coalesce(max_pct, 0)::bigint as max_pct from (select distinct name from documents where name is not null) left join (select name, max(pct) as max_pct from (select doc_a as name, pct from similar_pairs union all select doc_b, pct from similar_pairs) where name is not null and pct is not null group by name) using (name))"


def html(x: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        x = f"replace({x}, {q(a)}, {q(b)})"
    return x


# Length of the longest common subsequence of all tokens: one row of the table for each token of a, by recursion; values never
# fall along a row or column, so that the largest is the result.
LCS = f"""(with recursive tok as materialized (select check_id, {tokens_all('a')} as ta, {tokens_all('b')} as tb from {CHECKS}),
    b as materialized (select check_id, unnest(range(1, len(tb) + 1)) as j, unnest(tb) as w from tok),
    r(check_id, i, j, v) as (select check_id, 0::bigint, j, 0::bigint from b union all
        select check_id, i + 1, j, max(c) over (partition by check_id order by j) from (
            select r.check_id, r.i, r.j, greatest(r.v, case when b.w = tok.ta[r.i + 1] then 1 + coalesce(lag(r.v) over (partition by r.check_id order by r.j), 0) else 0 end) as c
            from r join b on b.check_id = r.check_id and b.j = r.j join tok on tok.check_id = r.check_id where r.i < len(tok.ta)))
    select check_id, coalesce(m, 0) as lcs, case when len(ta) = 0 or len(tb) = 0 then 0.0::double else least(coalesce(m, 0)::double / greatest(len(ta), len(tb)), 1.0) end as s
    from tok left join (select check_id, max(v) as m from r group by check_id) using (check_id))"""


def alignment_oracles(pair_similarity: str) -> dict[str, str]:
    cap = lambda x: f"least(100, floor({x} + 0.5)::int)::bigint"
    return {
        "lcs_similarity": f"select check_id, lcs, {rnd('s', 4)} as similarity, {pct('s')} as pct from {LCS}",
        "derived_percentages": f"select check_id, {cap('pct * 1.02::double')} as raised, {cap('cosine * 66::double')} as of_cosine, {cap(rnd('s', 4) + ' * 84::double')} as of_lcs from ({pair_similarity}) join {LCS} using (check_id)",
    }


def single_report_sql(pair_similarity: str, fingerprint_compare: str) -> str:
    as_documents = f"(select check_id as doc_id, a as t from {CHECKS})"
    here = lambda sql: sql.replace(D, as_documents)
    scores = ("cosine", "bigram", "trigram", "fingerprint", "lcs", "combined")
    value = lambda c: f"case when length(b) > 50 then {c} else 0.0::double end"
    figures = {"words": "words", "sentences": "sentences", "unique_words": "unique_words", "diversity": "diversity", "minutes": "minutes", "estimated_chars": "floor(words * 5.2::double + 0.5)::bigint"}
    rows = [f"select check_id, 'Document' as section, '{m}' as metric, ({x})::varchar as value, '' as percentage from w" for m, x in figures.items()]
    rows += [f"select check_id, 'Similarity', '{c}', ({value(c)})::varchar, {pct(value(c))} || '%' from w" for c in scores]
    rows += [f"select check_id, 'Style', '{m}', ({x})::varchar, '' from w" for m, x in (("percent", "style_pct"), ("verdict", "verdict"), ("certainty", "certainty"))]
    return f"""with w as materialized (select c.check_id as check_id, c.b as b, s.*, p.*, y.pct as style_pct, y.verdict as verdict, y.certainty as certainty, f.jaccard as fingerprint, {rnd('l.s', 4)} as lcs
        from {CHECKS} c join ({here(stats_sql())}) s on s.doc_id = c.check_id join {here(STYLE_ROWS)} y on y.doc_id = c.check_id
        join (select check_id as p_id, cosine, bigram, trigram, combined from ({pair_similarity})) p on p_id = c.check_id join ({fingerprint_compare}) f on f.check_id = c.check_id join {LCS} l on l.check_id = c.check_id)
        {' union all '.join(rows)}"""


def report_sources_sql(attribution: str, pair_similarity: str) -> str:
    listed = "(select check_id, u.url as url, min(coalesce(lower(trim(u.type)), 'unknown')) as type from (select check_id, unnest(sources) as u from single_checks) where u.url is not null group by all)"
    return f"""select check_id, row_number() over (partition by check_id order by pct desc, url nulls first) as rank, url, type, pct, measured from (
        select k.check_id, k.url, k.type, coalesce(m.pct, 0)::bigint as pct, true as measured from {listed} k left join ({attribution}) m on m.check_id = k.check_id and m.url = k.url
        union all select check_id, null, 'reference', pct, false from ({pair_similarity}) where check_id in (select check_id from single_checks where length(reference) > 50) and check_id not in (select check_id from {listed}))"""


def report_oracles() -> dict[str, str]:
    files = "(select file_id, max(r) as r from (select file_id, {'received_at': received_at, 'name': name, 'ext': ext, 'text': text, 'error': error} as r from parsed_files) group by file_id)"
    size = "coalesce(size, 0)"
    checked = f"(select doc_id, max({pct(rnd(COMBINED, 9))}) as similar_pct from {PAIR_ROWS} join (select distinct check_id, doc_id from single_checks where length(reference) > 30) using (check_id) group by doc_id)"
    summary = f"(select d.doc_id, d.name, s.words, s.sentences, y.pct as style_pct, y.verdict, coalesce(c.similar_pct, 0) as similar_pct, coalesce(m.max_pct, 0) as max_pct from documents d join ({stats_sql()}) s using (doc_id) join {STYLE_ROWS} y using (doc_id) left join {checked} c on c.doc_id = d.doc_id left join {RELATED} m on m.name = d.name)"
    src = f"(select check_id, u.url as url, min(regexp_replace(coalesce(u.snippet, ''), '<[^>]*>?', '', 'g')) as t from (select check_id, unnest(sources) as u from (select check_id, min({{'a': coalesce(submission, ''), 's': sources}}).s as sources from single_checks group by check_id)) where u.url is not null group by all)"
    matched = f"(select match_id, min({{'doc_id': doc_id, 's': {trimmed('sentence_a')}, 'sim': coalesce(similarity, 0.0)}}) as m from sentence_matches where sentence_a is not null group by match_id)"
    sent = f"(select doc_id, idx, {PLAIN_SENTENCE.format('unit')} as s from {unnest('doc_id', style('t'), ONE)})"
    return {
        "files_validated": f"select distinct file_id, reason = '' as valid, reason from (select file_id, case when not list_contains(['txt', 'pdf', 'docx', 'doc', 'md', 'csv'], {EXT}) then 'Unsupported file type: ' || {EXT} when coalesce(size, 0) = 0 then 'File is empty' else '' end as reason from parsed_files)",
        "files_dispatched": f"select lower(coalesce(r.ext, nullif(regexp_extract(r.name, '\\.([^./\\\\]+)$', 1), ''), '')) as ext, count(*) as n, count(r.text) as parsed, count(r.error) as failed, coalesce(sum(length({trimmed('r.text')})), 0)::bigint as chars from {files} group by 1",
        "session_inputs": f"select distinct file_id, length({trimmed('text')}) as n_chars from parsed_files where length({trimmed('text')}) >= 50",
        "corpus_names": "select name, arg_min(file_id, (received_at, file_id)) as file_id from parsed_files where name is not null group by name",
        "file_sizes": f"select distinct file_id, case when {size} < 1024 then {size}::varchar || ' B' when {size} < 1048576 then printf('%.1f', {rnd(f'{size} / 1024.0::double', 1)}) || ' KB' else printf('%.1f', {rnd(f'{size} / 1048576.0::double', 1)}) || ' MB' end as size_text from parsed_files",
        "source_snippets": f"select source_id, type, t as text from {SNIPPETS}",
        "source_queries": f"select doc_id, sample, query from {QUERIES}",
        "found_sources": f"select doc_id, rank, source_id, shared from (select *, row_number() over (partition by doc_id order by shared desc, source_id) as rank from (select doc_id, source_id, count(*) as shared from (select distinct doc_id, unnest(list_filter(string_split(query, ' '), lambda w: length(w) > 2)) as w from {QUERIES}) join (select distinct source_id, unnest({tokens_all('t')}) as w from {SNIPPETS}) using (w) group by all)) where rank <= 5",
        "source_attribution": f"select check_id, url, {pct(rnd('cosine', 9))} as pct from {scores(postings(CHECKS, 'check_id', tokens_content('a')), postings(src, 'check_id, url', tokens_content('t')), ['check_id'], [], ['url'])} where {pct(rnd('cosine', 9))} > 0",
        "inverted_index": f"select doc_id, term, string_agg(p::varchar, ',' order by p) as positions from (select doc_id, unnest(x) as term, unnest(range(0, len(x))) as p from (select doc_id, {tokens_all('t')} as x from {D})) group by all",
        "inverted_round_trip": "select distinct doc_id, true as same from documents",
        "csv_lines": f"select doc_id, '\"' || replace(coalesce(name, ''), '\"', '\"\"') || '\",\"' || words || '\",\"' || similar_pct || '%\",\"' || style_pct || '%\"' as line from {summary}",
        "html_reports": f"select distinct source_id, '<h1>' || {html('coalesce(url, ' + q('') + ')')} || '</h1><pre>' || {html('coalesce(snippet, ' + q('') + ')')} || '</pre>' as html from source_rows",
        "highlights": f"select doc_id, rank, strpos(t, s) - 1 as start_pos, strpos(t, s) - 1 + length(s) as end_pos, (rank - 1) % 5 as colour from (select m.doc_id as doc_id, m.s as s, row_number() over (partition by m.doc_id order by m.sim desc, match_id) as rank from {matched}) join {ONE} using (doc_id) where rank <= 20 and length(s) > 0 and strpos(t, s) > 0",
        "flagged_sentences": f"select doc_id, count(*) as sentences, count(*) filter (where hit) as flagged from (select s.doc_id, s.idx, length(s.s) > 5 and exists (select 1 from (select distinct doc_id, {PLAIN_SENTENCE.format('sentence_a')} as m from sentence_matches where sentence_a is not null) m where m.doc_id = s.doc_id and length(m.m) > 5 and (contains(s.s, m.m) or contains(m.m, s.s))) as hit from {sent} s) group by doc_id",
        "max_related": f"select name, max_pct from {RELATED}",
        "pair_report": "select doc_a, doc_b, pct::bigint as pct from (select least(doc_a, doc_b) as doc_a, greatest(doc_a, doc_b) as doc_b, max(pct) as pct from similar_pairs where doc_a <> doc_b and pct is not null group by 1, 2) order by pct desc, doc_a, doc_b limit 20",
        "document_summary": f"select *, case when max_pct >= 60 then 'high' when max_pct >= 30 then 'moderate' else 'low' end as band from {summary}",
        "bulk_counters": f"select count(*) as docs, count(*) filter (where max_pct >= 40) as similar_docs, count(*) filter (where style_pct >= 60) as styled_docs, (select count(*) from (select distinct pair_id, pct from similar_pairs) where pct >= 60) as strong_pairs from {summary}",
    }


def oracle_sql() -> dict[str, str]:
    out = base_oracles() | style_oracles() | sketch_oracles() | paraphrase_oracles() | report_oracles()
    out |= alignment_oracles(out["pair_similarity"])
    out["single_report"] = single_report_sql(out["pair_similarity"], out["fingerprint_compare"])
    out["report_sources"] = report_sources_sql(out["source_attribution"], out["pair_similarity"])
    return out
