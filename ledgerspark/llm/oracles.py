"""SQL counterparts of operators, for an engine that shares no code with them."""

from __future__ import annotations

from .ngram_rules import BUCKETS, LEAST_WORDS, MOST_REPEATED, SCALE, SMOOTHING, THRESHOLD, WINDOW

#: crc32 of text, from its bytes and the table of the polynomial.
_CRC_TABLE = """crc_table as (
  select list(v order by i) as t from (
    select i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]),
                          lambda c, step: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v
    from range(256) r(i))
)"""


def _crc(text: str) -> str:
    code = f"hex(encode({text}))"
    data = f"list_transform(range(0, length({code}) // 2), lambda k: ('0x' || substr({code}, 2 * k + 1, 2))::bigint)"
    steps = f"list_reduce(list_prepend(4294967295, {data}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))"
    return f"xor(4294967295, {steps})"


# All good labels are the trusted target, as in the operator.
NGRAM_QUALITY_RULES = f"""with {_CRC_TABLE},
texts as (
  select doc_id, coalesce(text, '') as text, row_number() over () as row,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words from documents
),
good as (select distinct doc_id from labels where quality = 1),
grams as (
  select row, doc_id, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) as gram
  from texts
),
buckets as (select gram, {_crc("gram")} % {BUCKETS} as bucket from (select distinct gram from grams), crc_table),
counts as (
  select bucket, count(*) as raw, count(*) filter (doc_id in (select doc_id from good)) as target
  from grams join buckets using (gram) group by bucket
),
sums as (select sum(raw)::double as raw_sum, sum(target)::double as target_sum from counts),
ratios as (
  select bucket, round({SCALE} * ln((target + {SMOOTHING * BUCKETS}::double * raw / raw_sum)
                                     / (target_sum + {SMOOTHING * BUCKETS}::double) / (raw / raw_sum)))::bigint as ratio
  from counts, sums
),
likely as (
  select row, sum(ratio)::double / {SCALE} / count(*) as llr
  from grams join buckets using (gram) join ratios using (bucket) group by row
),
windows as (
  select row, unnest(range(1, len(words) - {WINDOW - 2})) as place, words from texts where len(words) >= {WINDOW}
),
marked as (
  select row, place, count(*) over (partition by row, words[place : place + {WINDOW - 1}]) as often from windows
),
repeated as (
  select row, sum(least({WINDOW}, coalesce(following - place, {WINDOW})))::bigint as n from (
    select row, place, lead(place) over (partition by row order by place) as following from marked where often > 1
  ) group by row
),
lines as (
  select row, count(*) - count(distinct line) as n from (select row, unnest(string_split(text, chr(10))) as line from texts)
  where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by row
),
ruled as (
  select t.row, doc_id, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols,
         coalesce(l.n, 0)::bigint as n_dup_lines, coalesce(r.n, 0)::bigint as n_repeat_words, coalesce(llr, 0.0::double) as llr
  from texts t left join lines l on l.row = t.row left join repeated r on r.row = t.row left join likely k on k.row = t.row
),
judged as (
  select *, n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words as base_failed from ruled
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr,
       not base_failed and llr >= {THRESHOLD} as kept from judged"""


_TERMS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    " '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
)

NORM_BUCKET_SEARCH = f"""with texts as (select row_number() over () as row, doc_id, {_TERMS} as terms from documents),
items as (select row_number() over () as item, item_id, list_distinct({_TERMS}) as terms from benchmark),
totals as (select count(*)::bigint as docs, sum(len(terms))::bigint as words from texts where len(terms) > 0),
counted as (select row, term, count(*) as tf from (select row, unnest(terms) as term from texts) group by row, term),
weights as (
  select term, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)::double))::bigint as weight
  from (select term, count(*) as df from counted group by term), totals
),
impacts as (
  select row, doc_id, term, (1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * len(terms) * docs) // words)) as impact
  from counted join texts using (row), totals
),
scored as (
  select item, item_id, row, doc_id, sum(weight * impact)::bigint as score
  from (select item, item_id, unnest(terms) as term from items) join weights using (term) join impacts using (term)
  group by item, item_id, row, doc_id
),
placed as (
  select *, row_number() over (partition by item order by score desc, doc_id) as rank from scored where score > 0
)
select item_id, rank::int as rank, doc_id, score from placed where rank <= 50"""


_LEAF = " || ".join(
    f"coalesce(strlen({name}::varchar)::varchar || ':' || {name}::varchar, '-')" for name in ("doc_id", "source", "lang", "n_chars", "text")
)
_CHANGED = _LEAF.replace("n_chars::varchar", "(n_chars + 1)::varchar")

# Levels of the two parts of the tree, then the walk of every row up through both.
BUTTERFLY_MANIFEST = f"""with recursive {_CRC_TABLE},
leaves as (
  select doc_id, lang, sha256({_LEAF}) as leaf,
         case when {_crc("doc_id::varchar")} % 7 = 0 then sha256({_CHANGED}) else sha256({_LEAF}) end as received
  from documents, crc_table
),
ordered as (
  select *, row_number() over (partition by lang order by doc_id nulls last, leaf) - 1 as place,
         dense_rank() over (order by lang nulls first) - 1 as member
  from leaves
),
lower as (
  select member, 0 as level, place, leaf as node, count(*) over (partition by member) as total from ordered
  union all
  select member, level + 1, place // 2, sha256(string_agg(node, '' order by place)), (any_value(total) + 1) // 2
  from lower where total > 1 group by member, level, place // 2
),
subroots as (select member, node as subroot, level as height from lower where total = 1),
upper as (
  select 0 as level, member as place, subroot as node, count(*) over () as total from subroots
  union all
  select level + 1, place // 2, sha256(string_agg(node, '' order by place)), (any_value(total) + 1) // 2
  from upper where total > 1 group by level, place // 2
),
top as (select node as root, level as rounds from upper where total = 1),
nodes as (
  select l.member, l.level, l.place, l.node from lower l where total > 1
  union all select s.member, s.height + u.level, u.place, u.node from upper u, subroots s where u.level < (select rounds from top)
),
walk as (
  select doc_id, leaf, member, place as row, place, 0 as level, received as node, '' as proof from ordered
  union all
  select doc_id, leaf, w.member, row, case when w.level + 1 = height then w.member else w.at // 2 end, w.level + 1,
         sha256(case when w.at % 2 = 1 then coalesce(n.node, '') || w.node else w.node || coalesce(n.node, '') end),
         proof || coalesce(n.node, '')
  from (select *, case when walk.level = height then member else place end as at
        from walk join subroots using (member), top where walk.level < height + rounds) w
  left join nodes n on n.member = w.member and n.level = w.level and n.place = xor(w.at, 1)
)
select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, w.node as folded_root, w.node = root as verified
from walk w join subroots using (member), top where w.level = height + rounds"""
