"""The subpackage's queries: thin digests of its operators' results over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import conversations, decontaminate, jaccard, line_dedup, merkle, packing, pages, pii, quality, repeats, scoring, secret_scan, trie
from ._tables import table

Query = Callable[[SparkSession, str], DataFrame]


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.digest(table(spark, sf_dir, "documents"))


def op1_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op2_flat_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.digest(table(spark, sf_dir, "pages"))


def op3_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.scored(table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(table(spark, sf_dir, "documents"))


def op6_sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")))


def op7_induced_sorting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(table(spark, sf_dir, "documents"))


def op10_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.digest(table(spark, sf_dir, "conversations"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.digest(table(spark, sf_dir, "conversations"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digest(table(spark, sf_dir, "documents"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_weak_supervision, op2_flat_blocks, op3_context_mixing, op4_jaccard_components, op5_secret_scan, op6_sum_of_squares, op7_induced_sorting, op8_quality_rules, op9_winnowing, op10_quotation_links, op11_prefix_trie, op12_merkle_manifest, op13_line_dedup)}


_WORDS = r"regexp_extract_all(coalesce(text,''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz')"

#: op8's rules are fixed thresholds, so their order doesn't show in the result.
OP8 = rf"""WITH d AS (SELECT row_number() OVER () r, doc_id, coalesce(text,'') t, {_WORDS} w FROM documents),
c AS (SELECT *, len(w) n_words, length(regexp_replace(t,'[\x20\x09-\x0D]','','g')) word_chars, length(regexp_replace(t,'[^#*$%&|<>]','','g')) n_symbols, length(regexp_replace(t,'[^!]','','g')) n_shouts, length(regexp_replace(t,'\P{{Lu}}','','g')) n_upper, [x FOR x IN string_split(t,chr(10)) IF regexp_matches(x,'[^\x20\x09-\x0D]')] ls FROM d),
x AS (SELECT r, unnest(range(1,len(w)-1)) i, w FROM d WHERE len(w)>=3), v AS (SELECT r, i, w[i]||chr(10)||w[i+1]||chr(10)||w[i+2] g FROM x), u AS (SELECT r, g FROM v GROUP BY 1,2 HAVING count(*)>1),
p AS (SELECT DISTINCT r, unnest([i,i+1,i+2]) i FROM v JOIN u USING (r,g)), q AS (SELECT r, count(*) n FROM p GROUP BY 1),
a AS (SELECT doc_id, n_words, word_chars, n_symbols, n_shouts, n_upper, len(ls) n_lines, len(ls)-len(list_distinct(ls)) n_dup_lines, coalesce(q.n,0) n_repeat_words FROM c LEFT JOIN q USING (r)),
b AS (SELECT *, n_words<50 OR 100*n_repeat_words>50*n_words base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR 100*n_symbols>40*n_words OR 100*n_shouts>40*n_words OR 100*n_upper>60*word_chars OR word_chars<2*n_words OR word_chars>20*n_words OR (n_lines>=5 AND 100*n_dup_lines>50*n_lines)) kept FROM b"""

OP9 = rf"""WITH d AS (SELECT row_number() OVER () r, doc_id, regexp_extract_all({_LOWER},'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR),'') id, regexp_extract_all({_LOWER},'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark), k AS (SELECT id, w, least(10,len(w)) l FROM b WHERE len(w)>0),
i AS (SELECT DISTINCT id, l, array_to_string(w[j:j+l-1],' ') g FROM (SELECT *, unnest(range(1,len(w)-l+2)) j FROM k)),
s AS (SELECT r, l, j, array_to_string(w[j:j+l-1],' ') g FROM (SELECT r, w, l, unnest(range(1,len(w)-l+2)) j FROM d, (SELECT DISTINCT l FROM k) WHERE len(w)>=l)),
h AS (SELECT s.r, s.j, s.l, i.id FROM s JOIN i USING (l,g)), n AS (SELECT r, count(DISTINCT q) n FROM (SELECT r, unnest(range(j,j+l)) q FROM (SELECT DISTINCT r, j, l FROM h)) GROUP BY 1),
m AS (SELECT r, count(*) n, string_agg(id,',' ORDER BY id) ids FROM (SELECT DISTINCT r, id FROM h) GROUP BY 1)
SELECT doc_id, len(w) n_words, coalesce(n.n,0) n_hit, coalesce(m.n,0) n_items, sha256(coalesce(ids,'')) items_sha256, coalesce(n.n,0)>0 contaminated FROM d LEFT JOIN n USING (r) LEFT JOIN m USING (r)"""

OP4 = rf"""WITH RECURSIVE d AS (SELECT row_number() OVER () r, doc_id, regexp_extract_all({_LOWER},'[^\x20\x09-\x0D]+') w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i:i+least(4,len(w)-1)],' ') g FROM (SELECT r, w, unnest(range(1,greatest(len(w)-4,1)+1)) i FROM d WHERE len(w)>0)), n AS (SELECT r, count(*) n FROM s GROUP BY 1),
e AS (SELECT a.r x, b.r y, count(*) c FROM s a JOIN s b ON a.g=b.g AND a.r<b.r GROUP BY 1,2), l AS (SELECT x, y FROM e JOIN n p ON p.r=x JOIN n q ON q.r=y WHERE 100*c>=75*(p.n+q.n-c)),
t AS (SELECT x, y FROM l UNION SELECT y, x FROM l), c AS (SELECT r x, r y FROM d UNION SELECT c.x, t.y FROM c JOIN t ON t.x=c.y)
SELECT f.doc_id, coalesce(max(n.n),0) n_shingles, min(o.doc_id) component_id FROM c JOIN d f ON f.r=c.x JOIN d o ON o.r=c.y LEFT JOIN n ON n.r=c.x GROUP BY c.x, f.doc_id"""


def _crc32(value: str) -> str:
    """CRC-32 of a number's decimal text."""
    bits = "list_reduce(list_prepend(xor(c,b),range(8)), lambda a, k: xor(a>>1,3988292384*(a&1)))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT,[ascii(x)::BIGINT FOR x IN string_split(CAST({value} AS VARCHAR),'')]), lambda c, b: {bits}),4294967295)"


def _leaf(*values: str) -> str:
    return "sha256(" + "||".join(f"coalesce(strlen(CAST({v} AS VARCHAR))||':'||CAST({v} AS VARCHAR),'-')" for v in values) + ")"


OP11 = rf"""WITH s AS (SELECT DISTINCT conv_id c, {_crc32("conv_id")}%4 h FROM conversations WHERE conv_id IS NOT NULL), o AS (SELECT conv_id c, coalesce(role,'') a, coalesce(text,'') t, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role,''), coalesce(text,''))-1 p FROM conversations),
u AS (SELECT s.c, p i, a, t FROM s JOIN o ON o.c=s.c-s.c%20 AND p<h UNION ALL SELECT s.c, 10+p, a, t FROM s JOIN o ON o.c=s.c AND p>=h), v AS (SELECT c, row_number() OVER w d, t, sha256(string_agg(strlen(a)||':'||a||strlen(t)||':'||t,'') OVER w) k FROM u WINDOW w AS (PARTITION BY c ORDER BY i)),
r AS (SELECT * FROM v UNION ALL SELECT c, 0, '', '' FROM s), n AS (SELECT d, k, min(c) m, count(*) n, any_value(len(regexp_extract_all(t,'[^ 	-]+'))) w FROM r GROUP BY 1,2),
p AS (SELECT n.*, q.k above FROM n LEFT JOIN r q ON q.c=n.m AND q.d=n.d-1), g AS (SELECT d-1 d, above k, count(*) n FROM p GROUP BY 1,2), b AS (SELECT p.*, coalesce(g.n,0) kids FROM p LEFT JOIN g ON g.d=p.d AND g.k=p.k),
a AS (SELECT r.d, r.k, sum((b.n-1)*b.w) saved, count(*) FILTER (kids=0) leaves FROM b JOIN r ON r.c=b.m AND r.d<=b.d GROUP BY 1,2), l AS (SELECT c, max(d) d FROM r GROUP BY 1), e AS (SELECT d, k, sha256(string_agg(c,',' ORDER BY c)) x FROM r JOIN l USING (c,d) GROUP BY 1,2)
SELECT b.m conv_id, b.d depth, up.m parent_conv_id, b.n n_convs, b.kids n_children, a.leaves n_leaves, CAST(a.saved AS BIGINT) saved_tokens, coalesce(e.x,sha256('')) ends_sha256 FROM b JOIN a USING (d,k) LEFT JOIN e USING (d,k) LEFT JOIN n up ON up.d=b.d-1 AND up.k=b.above"""

OP12 = f"""WITH RECURSIVE d AS (SELECT row_number() OVER () r, *, CASE WHEN {_crc32("doc_id")}%2=0 THEN replace(text,chr(10),'') ELSE text END less FROM documents),
f AS (SELECT r, doc_id, source, {_leaf("doc_id", "source", "lang", "n_chars", "text")} leaf, {_leaf("doc_id", "source", "lang", "n_chars", "less")} changed FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, r)-1 i, count(*) OVER (PARTITION BY source) n FROM f),
t AS (SELECT source g, 0 l, i, n, leaf h FROM o UNION ALL SELECT g, l+1, i//3, (n+2)//3, sha256(string_agg(h,'' ORDER BY i)) FROM t WHERE n>1 GROUP BY g, l, i//3, n),
s AS (SELECT g, h, row_number() OVER (ORDER BY g NULLS FIRST)-1 i, count(*) OVER () n FROM t WHERE n=1),
u AS (SELECT 0 l, i, n, h FROM s UNION ALL SELECT l+1, i//3, (n+2)//3, sha256(string_agg(h,'' ORDER BY i)) FROM u WHERE n>1 GROUP BY l, i//3, n),
a AS (SELECT g, l, i, n, h FROM t WHERE n>1 UNION ALL SELECT s.g, 100+u.l, u.i, u.n, u.h FROM s, u WHERE u.n>1 AND u.i//3=s.i//CAST(pow(3,u.l+1) AS BIGINT)),
v AS (SELECT DISTINCT g, l FROM a), q AS (SELECT o.r, o.source g, v.l, CASE WHEN v.l<100 THEN o.i//CAST(pow(3,v.l) AS BIGINT) ELSE s.i//CAST(pow(3,v.l-100) AS BIGINT) END i FROM o JOIN v ON v.g IS NOT DISTINCT FROM o.source JOIN s ON s.g IS NOT DISTINCT FROM o.source),
y AS (SELECT q.r, q.l, row_number() OVER (PARTITION BY q.r ORDER BY q.l)-1 k, coalesce(string_agg(a.h,'' ORDER BY a.i) FILTER (a.i<q.i),'') b, coalesce(string_agg(a.h,'' ORDER BY a.i) FILTER (a.i>q.i),'') e FROM q JOIN a ON a.g IS NOT DISTINCT FROM q.g AND a.l=q.l AND a.i//3=q.i//3 GROUP BY 1,2),
z AS (SELECT r, 0 k, changed h FROM o UNION ALL SELECT z.r, z.k+1, sha256(y.b||z.h||y.e) FROM z JOIN y ON y.r=z.r AND y.k=z.k),
w AS (SELECT r, sha256(string_agg(b||e,'' ORDER BY k)) p FROM y GROUP BY 1), m AS (SELECT r, arg_max(h,k) h FROM z GROUP BY 1)
SELECT o.doc_id, o.leaf, s.h subroot, u.h root, coalesce(w.p,sha256('')) proof_sha256, m.h folded_root, m.h=u.h verified FROM o JOIN s ON s.g IS NOT DISTINCT FROM o.source JOIN u ON u.n=1 JOIN m USING (r) LEFT JOIN w USING (r)"""

OP13 = r"""WITH d AS (SELECT row_number() OVER () r, doc_id, string_split(coalesce(text,''),chr(10)) ls FROM documents), l AS (SELECT r, doc_id, unnest(ls) line, generate_subscripts(ls,1) i FROM d),
k AS (SELECT *, translate(trim(line,chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz') key FROM l), g AS (SELECT key, max(doc_id) top FROM k WHERE length(key)>=40 GROUP BY 1 HAVING count(DISTINCT r)>=5),
x AS (SELECT k.*, g.key IS NOT NULL AND doc_id IS DISTINCT FROM top gone FROM k LEFT JOIN g USING (key))
SELECT doc_id, count(*) n_lines, count(*) FILTER (gone) n_dropped, sha256(coalesce(string_agg(line,chr(10) ORDER BY i) FILTER (NOT gone),'')) kept_sha256 FROM x GROUP BY r, doc_id"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can say the whole result.  The others' own spans, scores, packings and cuts are tested against brute force."""
    return {"op4_jaccard_components": OP4, "op8_quality_rules": OP8, "op9_winnowing": OP9, "op11_prefix_trie": OP11, "op12_merkle_manifest": OP12, "op13_line_dedup": OP13}
