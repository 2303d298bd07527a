"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from vellum.llm.bpe import op1_bpe_encode_decode
from vellum.llm.hnsw import op3_hnsw_search
from vellum.llm.language_id import op8_language_id
from vellum.llm.licenses import op9_license_scan
from vellum.llm.line_dedup import op12_line_dedup
from vellum.llm.lm_scoring import op10_lm_scoring
from vellum.llm.media import op5_media_columns
from vellum.llm.mixing import op4_pfair_mix
from vellum.llm.ngram_join import op7_ngram_jaccard
from vellum.llm.sharding import op6_kd_sharding
from vellum.llm.spelling import op13_spelling_variants
from vellum.llm.token_counts import op2_prefix_token_counts
from vellum.llm.whitening import op11_embedding_whitening

QUERIES = {
    "op1_bpe_encode_decode": op1_bpe_encode_decode,
    "op2_prefix_token_counts": op2_prefix_token_counts,
    "op3_hnsw_search": op3_hnsw_search,
    "op4_pfair_mix": op4_pfair_mix,
    "op5_media_columns": op5_media_columns,
    "op6_kd_sharding": op6_kd_sharding,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_language_id": op8_language_id,
    "op9_license_scan": op9_license_scan,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_line_dedup": op12_line_dedup,
    "op13_spelling_variants": op13_spelling_variants,
}
#: op7: all pairs that share a shingle are counted, and links are followed from every document; fine for small tables.
#: op13: crc32 by its table, which a rule gives; words meet by what one deleted letter leaves.
ORACLES: dict[str, str] = {
    "op7_ngram_jaccard": r"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
    sets as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as g from w),
    s as (select doc_id, len(g) as n, unnest(g) as g from sets),
    pairs as (select a.doc_id as x, b.doc_id as y, any_value(a.n) as nx, any_value(b.n) as ny, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
    links as (select x, y from pairs where 100 * c >= 75 * (nx + ny - c)), edges as (select x, y from links union all select y, x from links),
    reach as (select doc_id as node, doc_id as root from documents union select e.y, r.root from reach r join edges e on e.x = r.node)
    select doc_id, cast(len(g) as bigint) as n_shingles, c as component_id from sets join (select node, min(root) as c from reach group by node) m on m.node = doc_id""",
    "op12_line_dedup": r"""with l as (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents),
    e as (select doc_id, unnest(range(1, len(l) + 1)) as pos, unnest(l) as line from l),
    k as (select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from e),
    owned as (select *, min(doc_id) over (partition by k) as owner from k),
    kept as (select *, length(k) < 10 or owner = doc_id as stays from owned)
    select doc_id, count(*) as n_lines, count(*) filter (not stays) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by pos) filter (stays), '')) as kept_sha256 from kept group by doc_id""",
    "op13_spelling_variants": r"""with recursive bits as (select range as i, range as v, 0 as k from range(256) union all select i, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end, k + 1 from bits where k < 8),
    tab as (select list(v order by i) as t from bits where k = 8),
    runs as (select doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as w, count(*) as n from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) as w from documents) group by 1, 2),
    coded as (select w, n, hex(encode(coalesce(cast(doc_id as varchar), '') || ':' || w)) as x from runs where length(w) >= 7),
    crc as (select w, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(x), 2), lambda i: cast('0x' || substr(x, i, 2) as bigint))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) as h from coded, tab),
    words as (select case when h % 31 = 0 then substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) else w end as word, cast(sum(n) as bigint) as n from crc group by 1 having sum(n) >= 2 and length(word) >= 7),
    less as (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as s from (select word, n, unnest(range(1, length(word) + 1)) as i from words)),
    near as (select a.word, b.word as near, b.n as m from less a join less b on a.i = b.i and a.s = b.s and a.word <> b.word
        union select a.word, b.word, b.n from less a join words b on a.s = b.word union select b.word, a.word, a.n from less a join words b on a.s = b.word),
    best as (select word, count(*) as n_near, first(near order by m desc, near) as near, max(m) as m from near group by word),
    forms as (select w.word, w.n, coalesce(b.n_near, 0) as n_near, case when m >= 10 * n then near end as form, case when m >= 10 * n then m end as form_n from words w left join best b using (word)),
    walk as (select word, word as root, form from forms union all select k.word, f.word, f.form from walk k join forms f on k.form = f.word)
    select f.word, f.form, w.root, f.n, f.n_near, f.form_n from forms f join walk w on w.word = f.word and w.form is null""",
}
