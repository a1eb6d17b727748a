"""DuckDB SQL for the corpus queries that SQL expresses in full, written apart from the operators.

The others - content-defined cuts, trained rules, quote trees, media and id files, token automata, tokenizers - are tested
against brute force, round trips and held-out labels in tests/llm instead.
"""

from __future__ import annotations

#: Exact search. The query finds exactly this while a table is no larger than a block of its curves.
_NEIGHBOURS = """with v as (select vec_id, cast(embedding as double[]) as e from embeddings where vec_id is not null and embedding is not null),
  w as (select * from v where len(e) > 0 and len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
  p as (select q.vec_id as query_id, c.vec_id, list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]), lambda a, b: a + b) as score from w q join w c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 20 = 0),
  r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from p)
select query_id, cast(rank as int) as rank, vec_id, score from r where rank <= 20"""

#: Shingle sets, all pairs that share one, links, and the smallest id that links reach.
_JACCARD = """with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
  s as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) end as t from d),
  x as (select doc_id, len(t) as n, unnest(t) as t from s),
  l as (select a.doc_id as a, b.doc_id as b from x a join x b on a.t = b.t and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))),
  g as (select doc_id as node, doc_id as reached from s union select g.node, l.b from g join l on g.reached = l.a)
select s.doc_id, cast(len(s.t) as bigint) as n_shingles, c.component_id from s join (select node, min(reached) as component_id from g group by node) c on c.node = s.doc_id"""

#: The budget of each source by pouring, then prefix sums in the order of the same random keys.
_MIXING = """with d as (select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as bigint) as size, substr(md5(concat_ws('|', doc_id, length(text), source)), 1, 15) as k from documents),
  p as (select source, cast(sum(size) as bigint) as source_size, 1 + (row_number() over (order by source nulls last) - 1) % 3 as weight from d group by source),
  r as (select *, 3 * source_size as cap, 3 * source_size / weight as ratio from p),
  o as (select *, (sum(source_size) over () - coalesce(sum(cap) over (order by ratio, source nulls last rows between unbounded preceding and 1 preceding), 0)) / (sum(weight) over () - coalesce(sum(weight) over (order by ratio, source nulls last rows between unbounded preceding and 1 preceding), 0)) as level from r),
  t as (select source, source_size, least(cast(cap as double), coalesce(weight * (select level from o where ratio >= level order by ratio, level limit 1), cast(cap as double))) as target from o),
  b as (select *, cast(round(target) as bigint) as budget from t),
  e as (select d.*, source_size, target, case when source_size > 0 then budget // source_size else 0 end as epochs, budget, coalesce(sum(size) over (partition by d.source order by k, doc_id nulls first, size rows between unbounded preceding and 1 preceding), 0) as ahead from d join b on d.source is not distinct from b.source)
select doc_id, size, source_size, target, cast(epochs * size + greatest(0, least(size, budget - epochs * source_size - ahead)) as bigint) as taken from e"""

#: All phrases by joins of consecutive words, the cuts' scores in 128 bits.
_PHRASES = """with d as (select coalesce(lang, 'und') as lang, row_number() over () as doc, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
  p as (select lang, doc, generate_subscripts(ps, 1) as piece, unnest(ps) as t from (select lang, doc, regexp_extract_all(t, '[^.,;:!?\\x0A-\\x0D]+') as ps from d)),
  w as (select lang, regexp_extract_all(t, '[^\\x20\\x09]+') as w from p),
  g as (select lang, w[i : i + k - 1] as g from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from (select lang, w, unnest([1, 2, 3, 4]) as k from w))),
  n as (select lang, cast(sum(len(w)) as bigint) as n from w group by lang),
  f as (select lang, g, count(*) as f from g group by lang, g having count(*) >= 30),
  c as (select lang, g, f as a, unnest(range(1, len(g))) as k from f where len(g) > 1),
  s as (select c.lang, c.g, a, k, l.f as l, r.f as r, (2000000 * cast(a as hugeint)) // (l.f + r.f) as score from c join f l on l.lang = c.lang and l.g = c.g[1 : k] join f r on r.lang = c.lang and r.g = c.g[k + 1 :]),
  b as (select *, row_number() over (partition by lang, g order by score, k) as best from s),
  i as (select lang, g[i : i + m - 1] as g, f from (select lang, g, f, m, unnest(range(1, len(g) - m + 2)) as i from (select lang, g, f, unnest(range(2, len(g))) as m from f where len(g) > 2))),
  x as (select lang, g, max(f) as longer from i group by lang, g),
  o as (select b.lang, array_to_string(b.g, ' ') as phrase, a, l, r, cast(score as bigint) as score from b left join x on x.lang = b.lang and x.g = b.g where best = 1 and (longer is null or 100 * longer < 80 * a)),
  q as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from o)
select q.lang, rank, phrase, a, l, r, n, score from q join n on n.lang = q.lang where rank <= 2000"""

#: Every document against every item by their common terms.
_LEXICAL = """with d as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as t from documents),
  c as (select doc_id, t, cast(len(t) as bigint) as n from d where len(t) > 0),
  a as (select count(*) as n_docs, cast(sum(n) as bigint) as n_terms from c),
  m as (select doc_id, t, 75 + (25 * n * n_docs) // n_terms as m from c cross join a),
  p as (select doc_id, m, term, count(*) as tf from (select doc_id, m, unnest(t) as term from m) u group by doc_id, m, term),
  f as (select term, count(*) as df from p group by term),
  w as (select term, cast(floor(1000 * ln(cast(2 * n_docs + 2 as double) / (2 * df + 1))) as bigint) as w from f cross join a),
  i as (select item_id, term, count(*) as q from (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from benchmark) u group by item_id, term),
  s as (select item_id, doc_id, cast(sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) as bigint) as score from i join p using (term) join w using (term) group by item_id, doc_id),
  r as (select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) as rank, doc_id, score from s where score > 0)
select * from r where rank <= 20"""

ORACLES: dict[str, str] = {"op2_hilbert_neighbours": _NEIGHBOURS, "op9_jaccard_join": _JACCARD, "op10_source_mixing": _MIXING, "op12_phrase_mining": _PHRASES, "op13_ranked_search": _LEXICAL}
