"""What each query of the catalogue computes, in ANSI-like SQL over the input tables."""

from __future__ import annotations

_SOURCES = "sources AS (SELECT source AS segment, concat_ws('/', source, lang, CAST(doc_id AS VARCHAR)) AS relative_path, text AS content, lang AS mime, n_chars AS size_bytes FROM documents)"

_CAMEL = "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), '')"

_FEATURES = f"""features AS (SELECT p_partkey AS decl_pos, 'shop.' || lower(p_type) || '.' || replace(p_brand, '#', '') AS class_fqn, {_CAMEL} AS simple_name, lower({_CAMEL}) AS simple_name_lower,
 CASE p_type WHEN 'ECONOMY' THEN 'METHOD' WHEN 'MEDIUM' THEN 'CONSTRUCTOR' WHEN 'PROMO' THEN 'FIELD' WHEN 'STANDARD' THEN 'ENUM_CONSTANT' WHEN 'LARGE' THEN 'CLASS' WHEN 'SMALL' THEN 'INTERFACE' END AS kind,
 p_size % 2 = 0 AS is_static, p_size % 3 = 0 AS is_public, p_size % 3 = 1 AS is_private FROM part)"""

_SIGNED = f"""{_FEATURES}, signed AS (SELECT *, CASE WHEN kind IN ('CLASS', 'INTERFACE') THEN kind || ':' || class_fqn WHEN kind IN ('FIELD', 'ENUM_CONSTANT') THEN kind || ':' || class_fqn || ':' || simple_name ELSE kind || ':' || class_fqn || ':' || simple_name || ':()V' END AS signature FROM features)"""

_USED = f"""{_SIGNED}, used AS (SELECT l_orderkey AS file, signature, l_linenumber AS line FROM lineitem JOIN signed ON l_partkey = decl_pos)"""

_LINES = "raw AS (SELECT doc_id AS path, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS l FROM documents), cut AS (SELECT path, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS line FROM raw), lines AS (SELECT *, CAST(sum(length(text) + 1) OVER (PARTITION BY path ORDER BY line) - 1 AS BIGINT) AS end_off, CAST(sum(length(text) + 1) OVER (PARTITION BY path ORDER BY line) - 1 - length(text) AS BIGINT) AS start_off FROM cut)"

_DIAGNOSED = """raw AS (SELECT doc_id AS path, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS l, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)), cut AS (SELECT path, quality, toxic, unnest(l) AS t, generate_subscripts(l, 1) AS line FROM raw),
 p AS (SELECT *, string_split(t, 'the ') AS pieces FROM cut WHERE contains(t, 'the ')), n AS (SELECT *, unnest(range(1, len(pieces))) AS i FROM p),
 h AS (SELECT path, line, CAST(length(array_to_string(pieces[1:i], 'the ')) + 1 AS BIGINT) AS "column", t, CASE WHEN quality = 0 THEN 'error' WHEN toxic = 1 THEN 'warning' ELSE 'note' END AS severity FROM n)"""

_SINGLE = r"""each AS (SELECT doc_id AS path, source AS segment, unnest(string_split(text, chr(10))) AS text FROM documents),
 single AS (SELECT path, segment, len(regexp_extract_all(text, '\S+')) AS value, upper(substr(md5(text), 1, 8)) || ':' || len(regexp_extract_all(text, '\S+')) AS hash FROM each WHERE len(regexp_extract_all(text, '\S+')) >= 10)"""

_DUP = "dup AS (SELECT hash, value, count(DISTINCT path) AS n_files, count(*) AS n_spans FROM single GROUP BY ALL HAVING count(DISTINCT path) >= 2)"

_PIECES = "tokens AS (SELECT l_orderkey AS path, l_linenumber * 12 AS offset_, min(l_partkey) AS part FROM lineitem GROUP BY l_orderkey, l_linenumber)"

_TOKENS = r"docs AS (SELECT doc_id AS path, text, [lang, source] AS types, doc_id % 10 <> 0 AS attributed, chr(1) || regexp_replace(trim(text, ' '), '[\s\x01]+', chr(1) || chr(1), 'g') || chr(1) AS tokens FROM documents)"


def _phrase(*words: str) -> str:
    return " || ".join(f"chr(1) || '{w}' || chr(1)" for w in words)


def _freq(*words: str) -> str:
    p = _phrase(*words)
    return f"(length(tokens) - length(replace(tokens, {p}, ''))) // length({p})"


_NL = "chr(10)"

#: The sources that corpus.java_files makes, and their parts: k is the part's key, up and t the classes that it extends and calls.
_JAVA = f"""java0 AS (SELECT p_partkey AS k, p_partkey // 4 AS up, p_partkey // 2 + 1 AS t, p_partkey % 3 AS j, p_partkey >= 4 AS derived, p_partkey % 2 = 0 AS even, p_partkey % 5 = 0 AS fifth FROM part),
 java1 AS (SELECT *, ' public void m' || j || '(int a, String b) {{' || {_NL} || '  if (!items.isEmpty() && a > 0) {{ count' || j || ' = items.size() + a; }}' || {_NL} || '  String s = "x.isEmpty()";' || {_NL} || ' }}' AS m_text,
  ' <T extends Comparable<T>> T pick(List<? extends T> l, T[] d) {{ return l.isEmpty() ? d[0] : l.get(0); }}' AS pick_text,
  ' void call(P' || t || ' o) {{ o.m' || (t % 3) || '(1, "x"); o.next().next(); }}' AS call_text,
  ' P' || up || ' next() {{ return null; }}' AS next_text,
  ' static class In {{ String s; boolean e() {{ return s.isEmpty(); }} }}' AS in_text FROM java0),
 java AS (SELECT *, 'package shop.p;' || {_NL} || 'import java.util.List;' || {_NL} || '/* items.isEmpty() in a comment */' || {_NL} || 'public class P' || k || CASE WHEN derived THEN ' extends P' || up ELSE '' END || CASE WHEN fifth THEN ' implements java.io.Serializable' ELSE '' END || ' {{' || {_NL}
  || ' private int count' || j || ';' || {_NL} || ' private List<String> items;' || {_NL} || m_text || {_NL} || CASE WHEN even THEN pick_text || {_NL} ELSE '' END || call_text || {_NL} || CASE WHEN derived THEN next_text || {_NL} ELSE '' END || CASE WHEN fifth THEN in_text || {_NL} ELSE '' END || '}}' || {_NL} AS content FROM java1)"""

_M, _PICK = "'(ILjava/lang/String;)V'", "'(Ljava/util/List;[Ljava/lang/Comparable;)Ljava/lang/Comparable;'"

#: Every class with itself and the classes above it.
_ABOVE = "above AS (SELECT k, k AS a FROM java UNION ALL SELECT k, a // 4 FROM above WHERE a >= 4)"


def _m_of(k: str) -> str:
    return f"'METHOD:shop.p.P' || {k} || ':m' || ({k} % 3) || ':' || {_M}"


def _next_of(k: str) -> str:
    return f"'METHOD:shop.p.P' || {k} || ':next:()Lshop/p/P' || ({k} // 4) || ';'"


#: Uses of methods: path, element, and whether it is what the used one overrides.
_CALLS = f"""calls AS (SELECT k, 'METHOD:java.util.Collection:isEmpty:()Z' AS element, false AS o FROM java
 UNION ALL SELECT k, 'METHOD:java.util.Collection:isEmpty:()Z', false FROM java WHERE even
 UNION ALL SELECT k, 'METHOD:java.util.Collection:size:()I', false FROM java
 UNION ALL SELECT k, 'METHOD:java.util.List:get:(I)Ljava/lang/Object;', false FROM java WHERE even
 UNION ALL SELECT k, 'METHOD:java.lang.String:isEmpty:()Z', false FROM java WHERE fifth
 UNION ALL SELECT k, 'METHOD:java.lang.CharSequence:isEmpty:()Z', true FROM java WHERE fifth
 UNION ALL SELECT k, {_m_of('t')}, false FROM java
 UNION ALL SELECT k, {_m_of('(t // 4)')}, true FROM java WHERE t >= 4 AND (t // 4) % 3 = t % 3
 UNION ALL SELECT k, {_next_of('t')}, false FROM java WHERE t >= 4
 UNION ALL SELECT k, {_next_of('(t // 4)')}, true FROM java WHERE t // 4 >= 4
 UNION ALL SELECT k, {_next_of('(t // 4)')}, false FROM java WHERE t // 4 >= 4
 UNION ALL SELECT k, {_next_of('(t // 16)')}, true FROM java WHERE t // 16 >= 4)"""

#: Uses of packages, types and fields.
_NAMES = """n1 AS (SELECT k, unnest(['PACKAGE:shop', 'PACKAGE:shop.p', 'PACKAGE:java', 'PACKAGE:java.util', 'INTERFACE:java.util.List', 'INTERFACE:java.util.List', 'CLASS:java.lang.String', 'CLASS:java.lang.String', 'CLASS:java.lang.String', 'FIELD:shop.p.P' || k || ':items', 'FIELD:shop.p.P' || k || ':items', 'FIELD:shop.p.P' || k || ':count' || j, 'CLASS:shop.p.P' || t]) AS element FROM java
 UNION ALL SELECT k, unnest(['CLASS:shop.p.P' || up, 'CLASS:shop.p.P' || up]) FROM java WHERE derived
 UNION ALL SELECT k, unnest(['PACKAGE:java', 'PACKAGE:java.io', 'INTERFACE:java.io.Serializable', 'CLASS:java.lang.String', 'FIELD:shop.p.P' || k || '$In:s']) FROM java WHERE fifth
 UNION ALL SELECT k, unnest(['INTERFACE:java.lang.Comparable', 'INTERFACE:java.util.List']) FROM java WHERE even)"""

#: Matches of the rules of q46: label, the piece of text that stands there, and where that begins in a longer piece.
_HITS = r"""hits AS (SELECT k, content, unnest(['Usage of isEmpty', 'typed']) AS label, strpos(content, '!items.isEmpty()') AS start_off, length('items.isEmpty()') AS n FROM java
 UNION ALL SELECT k, content, unnest(['Usage of isEmpty', 'typed']), strpos(content, 'return l.isEmpty()') + 6, length('l.isEmpty()') FROM java WHERE even
 UNION ALL SELECT k, content, unnest(['Usage of isEmpty', 'text']), strpos(content, 'return s.isEmpty()') + 6, length('s.isEmpty()') FROM java WHERE fifth
 UNION ALL SELECT k, content, 'choice', strpos(content, 'return l.isEmpty()') + 6, length('l.isEmpty() ? d[0] : l.get(0)') FROM java WHERE even
 UNION ALL SELECT k, content, 'guard', strpos(content, '  if (!items') + 1, length('if (!items.isEmpty() && a > 0) { count' || j || ' = items.size() + a; }') FROM java)"""

_OF_THE, _DE_LA = _phrase("of", "the"), _phrase("de", "la")

_CHANGES = "changes AS (SELECT o_orderkey % 3000 AS p_partkey, o_orderkey AS seq, CASE WHEN o_orderstatus = 'F' THEN 'delete' ELSE 'put' END AS op, o_totalprice AS p_retailprice FROM orders), last AS (SELECT p_partkey, arg_max(op, seq) AS op, arg_max(p_retailprice, seq) AS p_retailprice FROM changes GROUP BY p_partkey), upserted AS (SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM last) UNION ALL SELECT p_partkey, 'changed', p_retailprice FROM last WHERE op <> 'delete')"

ORACLES: dict[str, str] = {
    "q01_file_statistics": f"WITH {_SOURCES} SELECT 'files/total' AS key, count(*) AS value FROM sources UNION ALL SELECT 'files/' || mime, count(*) FROM sources WHERE mime IS NOT NULL GROUP BY mime UNION ALL SELECT 'fileSize/total', CAST(sum(size_bytes) AS BIGINT) FROM sources UNION ALL SELECT 'fileSize/' || mime, CAST(sum(size_bytes) AS BIGINT) FROM sources WHERE mime IS NOT NULL GROUP BY mime",
    "q02_keyed_counters": f"WITH {_SOURCES}, c AS (SELECT 'segment/' || segment AS key, 1 AS value FROM sources UNION ALL SELECT 'mime/' || mime, 1 FROM sources UNION ALL SELECT 'size/' || mime, size_bytes FROM sources UNION ALL SELECT 'total', 1 FROM sources) SELECT key, CAST(sum(value) AS BIGINT) AS value FROM c WHERE key IS NOT NULL GROUP BY key",
    "q03_element_statistics": f"WITH {_FEATURES} SELECT CASE WHEN kind IN ('CLASS', 'INTERFACE') THEN 'java-classes' WHEN kind IN ('FIELD', 'ENUM_CONSTANT') THEN 'java-fields' ELSE 'java-methods' END AS key, count(*) AS value FROM features GROUP BY 1",
    "q04_signatures": f"WITH {_SIGNED}, p AS (SELECT decl_pos, signature, string_split(signature, ':') AS s FROM signed) SELECT decl_pos, signature, len(s) AS n_parts, s[2] AS owner, s[3] AS name, split_part(s[2], '$', 1) AS top_level FROM p",
    "q05_distinct_usages": f"WITH {_USED} SELECT file, count(DISTINCT signature) AS n_signatures FROM used GROUP BY file",
    "q06_references": rf"""WITH {_SOURCES}, f AS (SELECT relative_path AS file, content FROM sources UNION ALL SELECT url, html FROM pages), n AS (SELECT file, unnest(regexp_extract_all(content, '[A-Za-z_][A-Za-z0-9_]*(?:[.-][A-Za-z_][A-Za-z0-9_]*)+')) AS name FROM f), p AS (SELECT file, string_split(replace(name, '-', '.'), '.') AS parts FROM n), u AS (SELECT file, parts, unnest(range(2, len(parts) + 1)) AS n FROM p) SELECT DISTINCT file, array_to_string(parts[1:n], '.') AS reference FROM u""",
    "q07_categories": f"WITH {_SOURCES} SELECT segment, count(*) AS n_files, CAST(sum(size_bytes) AS BIGINT) AS index_size, count(DISTINCT mime) AS n_mimes, upper(substr(segment, 1, 1)) || substr(segment, 2) AS display_name FROM sources GROUP BY segment",
    "q08_projects": r"WITH u AS (SELECT regexp_replace(url, '^https?://', '') AS path FROM pages), k AS (SELECT path FROM u WHERE len(list_filter(string_split(path, '/'), lambda c: regexp_matches(c, '^m\..*$'))) = 0) SELECT DISTINCT CASE WHEN regexp_matches(path, '^(.*)/en/[0-9]+') THEN regexp_extract(path, '^(.*)/en/[0-9]+', 1) ELSE regexp_extract(path, '^(.*)/de/[0-9]+', 1) END AS project FROM k WHERE regexp_matches(path, '^(.*)/(en|de)/[0-9]+')",
    "q09_prefix_search": f"WITH {_FEATURES} SELECT 'prefix' AS search, decl_pos, simple_name FROM features WHERE starts_with(simple_name, 'Sm') UNION ALL SELECT 'any case', decl_pos, simple_name FROM features WHERE starts_with(simple_name_lower, 'sm')",
    "q10_wildcard_search": f"WITH {_FEATURES} SELECT decl_pos, simple_name FROM features WHERE regexp_matches(simple_name_lower, '^r.*g.t$')",
    "q11_camel_search": f"WITH {_FEATURES} SELECT decl_pos, simple_name, CASE WHEN kind IN ('CLASS', 'INTERFACE') THEN 'CLASS' ELSE kind END AS kind, class_fqn AS enclosing FROM features WHERE regexp_matches(simple_name, '^R[a-z0-9_$]*W.*$') OR starts_with(simple_name_lower, 'rw')",
    "q12_binary_names": f"WITH {_FEATURES} SELECT decl_pos, simple_name AS simple, split_part(class_fqn, '.', 3) AS outer_name, split_part(class_fqn, '.', 1) || '.' || split_part(class_fqn, '.', 2) AS package, 'src/' || replace(class_fqn, '.', '/') || '.java' AS file FROM features",
    "q13_phrase_search": f"WITH {_TOKENS} SELECT path FROM docs WHERE contains(tokens, {_OF_THE})",
    "q14_pattern_frequencies": f"""WITH {_TOKENS} SELECT path, 'of the' AS pattern, {_freq('of', 'the')} AS freq FROM docs WHERE contains(tokens, {_OF_THE})
 UNION ALL SELECT path, 'de la', {_freq('de', 'la')} FROM docs WHERE contains(tokens, {_DE_LA}) AND (NOT attributed OR list_contains(types, 'es'))
 UNION ALL SELECT path, 'the and of', {_freq('the')} FROM docs WHERE contains(tokens, {_phrase('the')}) AND contains(tokens, {_phrase('and')}) AND contains(tokens, {_phrase('of')}) AND (NOT attributed OR list_contains(types, 'en'))""",
    "q15_validated_patterns": rf"WITH {_TOKENS}, c AS (SELECT path, len(regexp_extract_all(text, '\bof the\b')) AS n_exact FROM docs WHERE contains(tokens, {_OF_THE})) SELECT path, n_exact FROM c WHERE n_exact > 0",
    "q16_kind_groups": f"WITH {_FEATURES} SELECT CASE WHEN kind IN ('CLASS', 'INTERFACE') THEN 'types' WHEN kind IN ('FIELD', 'ENUM_CONSTANT') THEN 'fields' WHEN kind = 'METHOD' THEN 'methods' ELSE 'others' END AS kind_group, class_fqn, count(*) AS n FROM features GROUP BY 1, 2",
    "q17_source_roots": f"WITH {_SOURCES}, roots AS (SELECT DISTINCT segment || '/' AS root FROM sources UNION SELECT DISTINCT segment || '/' || mime || '/' FROM sources), j AS (SELECT relative_path, root, row_number() OVER (PARTITION BY relative_path ORDER BY length(root) DESC) AS nth FROM sources JOIN roots ON starts_with(relative_path, root)) SELECT root, count(*) AS n_all, count(*) FILTER (nth = 1) AS n_longest FROM j GROUP BY root",
    "q18_usages": f"""WITH {_USED}, wanted AS (SELECT DISTINCT signature, class_fqn || '.' || simple_name AS reference FROM signed), old AS (SELECT signature, bool_or(is_static) AS static FROM signed GROUP BY 1),
 form AS (SELECT u.signature, file, CASE WHEN static THEN 'legacy' ELSE 'direct' END AS found FROM used u JOIN old o ON u.signature = o.signature),
 resource AS (SELECT w.signature, s.decl_pos AS file, 'resource' AS found FROM wanted w JOIN signed s ON s.class_fqn || '.' || s.simple_name = w.reference)
 SELECT signature, found, count(*) AS n, count(DISTINCT file) AS n_files FROM (SELECT * FROM form UNION ALL SELECT * FROM resource) GROUP BY 1, 2""",
    "q19_unused": f"WITH {_FEATURES} SELECT decl_pos * 2 AS decl_pos, class_fqn, simple_name FROM features WHERE NOT is_static AND decl_pos * 2 NOT IN (SELECT l_partkey FROM lineitem)",
    "q20_duplicate_hashes": f"WITH {_SINGLE}, {_DUP} SELECT hash, value, n_files, n_spans FROM dup",
    "q21_duplicate_groups": rf"""WITH {_LINES}, f AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line) AS nth, md5(text) AS mark, len(regexp_extract_all(text, '\S+')) AS value FROM lines WHERE len(regexp_extract_all(text, '\S+')) > 0),
 x AS (SELECT *, coalesce(lead(mark) OVER (PARTITION BY path ORDER BY nth), '') AS next FROM f),
 g AS (SELECT mark, value, count(DISTINCT path) AS n_files, count(*) AS n_spans, min(next) AS lo, max(next) AS hi, min(struct_pack(path := path, nth := nth, line := line, start_off := start_off, end_off := end_off)) AS f FROM x GROUP BY 1, 2 HAVING count(DISTINCT path) >= 2),
 l AS (SELECT b.*, EXISTS (SELECT 1 FROM g a WHERE a.lo = a.hi AND a.lo = b.mark AND a.n_spans = b.n_spans) AS goes_on FROM g b),
 i AS (SELECT *, CASE WHEN goes_on AND lag(f.nth) OVER w = f.nth - 1 THEN 0 ELSE 1 END AS new FROM l WINDOW w AS (PARTITION BY f.path ORDER BY f.nth)),
 r AS (SELECT *, sum(new) OVER (PARTITION BY f.path ORDER BY f.nth) AS island FROM i),
 o AS (SELECT f.path AS path, island, CAST(sum(value) AS BIGINT) AS value, count(*) AS n_lines, min(n_files) AS n_files, min(n_spans) AS n_spans, min(f.start_off) AS start_off, max(f.end_off) AS end_off, upper(substr(md5(string_agg(upper(substr(mark, 1, 16)), '' ORDER BY f.nth)), 1, 8)) || ':' || CAST(sum(value) AS BIGINT) AS hash FROM r GROUP BY 1, 2)
 SELECT value, n_lines, n_files, n_spans, path, start_off, end_off FROM o WHERE value >= 10 ORDER BY value DESC, hash LIMIT 100""",
    "q22_hashes_by_category": f"""WITH {_SINGLE}, {_DUP}, asked AS (SELECT hash FROM dup UNION ALL SELECT '00000000:0'), cats AS (SELECT DISTINCT source AS segment FROM documents WHERE source IS NOT NULL), found AS (SELECT hash, segment, count(DISTINCT path) AS n, array_to_string(list_sort(list(DISTINCT path)), ',') AS files FROM single GROUP BY 1, 2) SELECT hash, segment, coalesce(n, 0) AS n_files, coalesce(files, '') AS files FROM asked CROSS JOIN cats LEFT JOIN found USING (hash, segment)""",
    "q23_usage_and_subtypes": f"""WITH {_FEATURES}, e AS (SELECT l_orderkey AS file, l_partkey, is_public FROM lineitem JOIN features ON decl_pos = l_partkey), u AS (SELECT file, count(*) AS n FROM e WHERE is_public GROUP BY 1), s AS (SELECT file, list_sort(list(DISTINCT l_partkey)) AS subs FROM e WHERE NOT is_public GROUP BY 1) SELECT file, n IS NOT NULL AS usage, coalesce(n, 0) AS n_usages, coalesce(array_to_string(subs, ','), '') AS subtypes FROM u FULL OUTER JOIN s USING (file)""",
    "q24_classpath": f"WITH {_FEATURES}, o AS (SELECT DISTINCT class_fqn AS entry, CAST('0x' || substr(md5(class_fqn), 1, 8) AS BIGINT) AS ordinal FROM features), f AS (SELECT DISTINCT simple_name AS name, class_fqn AS entry FROM features) SELECT name, arg_min(entry, ordinal) AS entry, min(ordinal) AS ordinal FROM f JOIN o USING (entry) GROUP BY name",
    "q25_random_files": f"WITH {_SOURCES} SELECT relative_path, md5(relative_path || ':42') AS mark FROM sources ORDER BY mark, relative_path LIMIT 30",
    "q26_decoded_signatures": f"""WITH {_FEATURES} SELECT decl_pos, CASE kind WHEN 'METHOD' THEN '<T:Ljava/lang/String;>(Ljava/util/Map<Ljava/util/List<Ljava/lang/String;>;TT;>;Z)V;' WHEN 'CONSTRUCTOR' THEN '(Ljava/util/List<+Ljava/lang/String;>;[[I)V;' WHEN 'FIELD' THEN '()Lshop/Box$Lid<**>;' WHEN 'ENUM_CONSTANT' THEN '(J-D)V' ELSE '()V' END AS encoded,
 CASE kind WHEN 'METHOD' THEN '(Map<List<String>, T>, boolean)' WHEN 'CONSTRUCTOR' THEN '(List<? extends String>, int[][])' WHEN 'FIELD' THEN '()' WHEN 'ENUM_CONSTANT' THEN '(long, ? super double)' ELSE '()' END AS decoded FROM features""",
    "q27_icons": f"""WITH {_FEATURES}, x AS (SELECT *, CASE WHEN is_public THEN 'Public' WHEN is_private THEN 'Private' ELSE 'Package' END AS seen, CASE WHEN is_static THEN 'Static' ELSE '' END AS st FROM features)
 SELECT decl_pos, CASE kind WHEN 'FIELD' THEN 'variable' || st || seen WHEN 'METHOD' THEN 'method' || st || seen WHEN 'CONSTRUCTOR' THEN 'constructor' || seen WHEN 'ENUM_CONSTANT' THEN 'constant' WHEN 'INTERFACE' THEN 'interface' ELSE 'class' END AS icon FROM x""",
    "q28_category_labels": "SELECT p_partkey, '[' || regexp_replace(regexp_replace(replace(replace(CASE WHEN p_partkey % 3 = 0 THEN p_name || ' == ' || p_brand ELSE p_name || ' != ' || p_brand || '!!' END, '==', 'equals'), '!=', 'not_equals'), '[^A-Za-z0-9]', '_', 'g'), '_+', '_', 'g') || '] ' AS label FROM part",
    "q29_escaping": """WITH k AS (SELECT p_partkey, p_name, replace(p_name, ' ', '__') || CASE WHEN p_partkey % 2 = 0 THEN '$' ELSE '_' END || p_type AS key FROM part) SELECT p_partkey, replace(replace(key, '__', '___'), '$', '__d') AS escaped, replace(replace(replace(replace(key, '__', '___'), '$', '__d'), '__d', '$'), '___', '__') AS unescaped, '&lt;a href=&quot;' || p_name || '&quot;&gt;&amp;<br>' AS html FROM k""",
    "q30_use_types": f"WITH {_FEATURES}, b AS (SELECT l_partkey AS decl_pos, array_to_string(list_sort(list(DISTINCT CASE l_linenumber % 3 WHEN 0 THEN 'READ' WHEN 1 THEN 'WRITE' ELSE 'EXECUTE' END)), '|') AS uses, count(*) AS n FROM lineitem GROUP BY 1) SELECT f.decl_pos, coalesce(uses, '') AS uses, coalesce(n, 0) AS n_uses, is_private AND NOT coalesce(contains(uses, 'READ'), false) AS unused FROM features f LEFT JOIN b USING (decl_pos)",
    "q31_offsets": "WITH s AS (SELECT l_orderkey AS file, l_partkey AS decl_pos, l_linenumber AS line, l_partkey % 17 + 1 AS span FROM lineitem) SELECT *, CAST(sum(span) OVER w AS BIGINT) AS end_off, CAST(sum(span) OVER w AS BIGINT) - span AS start_off FROM s WINDOW w AS (PARTITION BY file ORDER BY line, decl_pos ROWS UNBOUNDED PRECEDING)",
    "q32_narrowest": f"""WITH {_LINES}, i AS (SELECT path, start_off, end_off FROM lines UNION ALL SELECT path, start_off, start_off + (end_off - start_off) // 2 FROM lines), p AS (SELECT doc_id AS path, n_chars // 3 AS point FROM documents UNION SELECT doc_id, n_chars // 2 + 1 FROM documents),
 j AS (SELECT p.path, point, start_off, end_off, row_number() OVER (PARTITION BY p.path, point ORDER BY end_off - start_off, start_off) AS nth FROM p JOIN i ON p.path = i.path AND start_off <= point AND point <= end_off) SELECT path, point, start_off, end_off FROM j WHERE nth = 1""",
    "q33_diagnostics": rf"""WITH {_DIAGNOSED}
 SELECT path, line, "column", severity, path || ':' || line || ': ' || severity || ': [Usage_of_the] Usage of the' || chr(10) || t || chr(10) || regexp_replace(substr(t, 1, CAST("column" - 1 AS INTEGER)), '[^\t]', ' ', 'g') || '^' AS message FROM h""",
    "q34_status": """WITH s AS (SELECT source AS "group", CASE WHEN quality IS NULL THEN 0 WHEN quality = 0 THEN 3 WHEN d.doc_id % 2 = 0 THEN 2 ELSE 1 END AS rank FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) SELECT "group", CASE max(rank) WHEN 0 THEN 'NOTHING_TO_DO' WHEN 1 THEN 'NO_HINTS_FOUND' WHEN 2 THEN 'SUCCESS' ELSE 'FAILURE' END AS status FROM s GROUP BY 1""",
    "q35_access_counts": "SELECT event_type || ':' || user_id AS key, count(*) AS n FROM events GROUP BY 1",
    "q36_hourly_counts": "SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1",
    "q37_streamed_counts": "SELECT event_type || ':' || user_id AS key, count(*) AS n FROM events GROUP BY 1",
    "q38_upsert": f"WITH {_CHANGES} SELECT * FROM upserted",
    "q39_snapshot_difference": f"WITH {_CHANGES} SELECT coalesce(b.p_partkey, a.p_partkey) AS path, CASE WHEN b.p_partkey IS NULL THEN 'added' WHEN a.p_partkey IS NULL THEN 'removed' ELSE 'changed' END AS change FROM part b FULL OUTER JOIN upserted a ON a.p_partkey = b.p_partkey WHERE b.p_partkey IS NULL OR a.p_partkey IS NULL OR a.p_retailprice <> b.p_retailprice",
    "q40_closure": """WITH RECURSIVE e AS (SELECT 'C' || c_custkey AS child, 'N' || c_nationkey AS parent FROM customer UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation), w AS (SELECT child, parent AS ancestor, 1 AS depth FROM e UNION ALL SELECT w.child, e.parent, depth + 1 FROM w JOIN e ON w.ancestor = e.child) SELECT ancestor, depth, count(*) AS n FROM w GROUP BY 1, 2""",
    "q41_snippets": rf"""WITH {_LINES}, m AS (SELECT path, line, text, length(trim(text, ' ')) > 0 AS f, count(*) FILTER (length(trim(text, ' ')) > 0) OVER (PARTITION BY path ORDER BY line) AS n FROM lines), h AS (SELECT path, line, n - CASE WHEN f THEN 1 ELSE 0 END AS h_before, n AS h_upto FROM m WHERE regexp_matches(text, '(?i)\bcopyright\b|licen[sc]e'))
 SELECT h.path, h.line, least(min(m.line), h.line) AS first_line, greatest(max(m.line), h.line) AS last_line FROM h JOIN m ON m.path = h.path AND m.f AND m.n > h_before - 2 AND m.n <= h_upto + 2 GROUP BY h.path, h.line""",
    "q42_common_prefix": f"WITH {_SOURCES}, b AS (SELECT segment, min(relative_path) AS a, max(relative_path) AS b FROM sources GROUP BY 1) SELECT segment, substr(a, 1, list_max(list_filter(range(0, least(length(a), length(b)) + 1), lambda i: substr(a, 1, i) = substr(b, 1, i)))) AS common FROM b",
    "q43_span_codec": "WITH s AS (SELECT DISTINCT l_orderkey AS file, l_partkey AS a, l_partkey + l_linenumber AS b FROM lineitem), p AS (SELECT file, string_agg(a || ':' || b, ':' ORDER BY a, b) AS spans, string_agg(a || ':' || (b - a), ';' ORDER BY a, b) AS positions FROM s GROUP BY file) SELECT file, spans, positions, spans AS again FROM p",
    "q44_use_patterns": f"""WITH {_FEATURES} SELECT decl_pos, CASE WHEN kind IN ('CLASS', 'INTERFACE') THEN class_fqn || ';;' WHEN kind = 'CONSTRUCTOR' THEN 'new ' || class_fqn || '();;' WHEN is_static THEN class_fqn || '.' || simple_name || CASE WHEN kind = 'METHOD' THEN '()' ELSE '' END || ';;' ELSE '$this.' || simple_name || CASE WHEN kind = 'METHOD' THEN '()' ELSE '' END || ' :: $this instanceof ' || class_fqn || ';;' END AS rule FROM features""",
    "q45_java_declarations": f"""WITH {_JAVA} SELECT k AS path, 'CLASS' AS kind, 'P' || k AS simple_name, '' AS descriptor, '' AS signature, 'CLASS:shop.p.P' || k AS element FROM java
 UNION ALL SELECT k, 'FIELD', 'count' || j, '', 'I', 'FIELD:shop.p.P' || k || ':count' || j FROM java
 UNION ALL SELECT k, 'FIELD', 'items', '', 'Ljava/util/List<Ljava/lang/String;>;', 'FIELD:shop.p.P' || k || ':items' FROM java
 UNION ALL SELECT k, 'METHOD', 'm' || j, {_M}, {_M} || ';', {_m_of('k')} FROM java
 UNION ALL SELECT k, 'METHOD', 'pick', {_PICK}, '<T:Ljava/lang/Comparable<TT;>;>(Ljava/util/List<+TT;>;[TT;)TT;;', 'METHOD:shop.p.P' || k || ':pick:' || {_PICK} FROM java WHERE even
 UNION ALL SELECT k, 'METHOD', 'call', '(Lshop/p/P' || t || ';)V', '(Lshop/p/P' || t || ';)V;', 'METHOD:shop.p.P' || k || ':call:(Lshop/p/P' || t || ';)V' FROM java
 UNION ALL SELECT k, 'METHOD', 'next', '()Lshop/p/P' || up || ';', '()Lshop/p/P' || up || ';;', {_next_of('k')} FROM java WHERE derived
 UNION ALL SELECT k, 'CLASS', 'In', '', '', 'CLASS:shop.p.P' || k || '$In' FROM java WHERE fifth
 UNION ALL SELECT k, 'FIELD', 's', '', 'Ljava/lang/String;', 'FIELD:shop.p.P' || k || '$In:s' FROM java WHERE fifth
 UNION ALL SELECT k, 'METHOD', 'e', '()Z', '()Z;', 'METHOD:shop.p.P' || k || '$In:e:()Z' FROM java WHERE fifth""",
    "q46_rule_occurrences": rf"""WITH {_JAVA}, {_HITS}, b AS (SELECT *, substr(content, 1, CAST(start_off AS INTEGER)) AS before FROM hits) SELECT k AS path, label, start_off, start_off + n AS end_off, length(before) - length(replace(before, chr(10), '')) + 1 AS line, length(regexp_extract(before, '[^\n]*$')) + 1 AS "column" FROM b""",
    "q47_rule_rewrites": f"""WITH {_JAVA} SELECT k AS path, replace(replace(replace(content, '  if (!items.isEmpty() && a > 0)', '  if (a > 0)'), 'return l.isEmpty() ?', 'return l.size() == 0 ?'), 'return s.isEmpty();', 'return s.length() == 0;') AS content, 2 * (1 + CASE WHEN even THEN 1 ELSE 0 END + CASE WHEN fifth THEN 1 ELSE 0 END) AS n_changed_lines FROM java""",
    "q48_subtypes": f"""WITH RECURSIVE {_JAVA}, {_ABOVE} SELECT 'shop.p.P' || a AS type, k AS path, 'shop.p.P' || k AS class FROM above WHERE a <> k UNION ALL SELECT 'java.lang.Object', k, 'shop.p.P' || k FROM java UNION ALL SELECT DISTINCT 'java.io.Serializable', k, 'shop.p.P' || k FROM above WHERE a % 5 = 0 UNION ALL SELECT 'java.lang.Object', k, 'shop.p.P' || k || '$In' FROM java WHERE fifth""",
    "q49_overrides": f"""WITH {_JAVA} SELECT k AS path, {_m_of('k')} AS element, {_m_of('up')} AS overridden FROM java WHERE derived AND up % 3 = k % 3
 UNION ALL SELECT k, {_next_of('k')}, {_next_of('up')} FROM java WHERE up >= 4
 UNION ALL SELECT k, 'METHOD:shop.p.P' || k || ':pick:' || {_PICK}, 'METHOD:shop.p.P' || up || ':pick:' || {_PICK} FROM java WHERE derived AND even AND up % 2 = 0""",
    "q50_java_usages": f"""WITH {_JAVA}, {_CALLS} SELECT k AS path, element, o AS is_override, count(*) AS n FROM calls GROUP BY ALL""",
    "q51_used_types": f"""WITH {_JAVA}, {_NAMES} SELECT element, count(*) AS n, count(DISTINCT k) AS n_files FROM n1 GROUP BY 1""",
    "q53_file_flags": f"""WITH RECURSIVE {_JAVA}, {_ABOVE}, {_CALLS}, {_NAMES},
 u1 AS (SELECT DISTINCT k FROM n1 WHERE element = 'CLASS:shop.p.P2'), s1 AS (SELECT k FROM above WHERE a = 2 AND k <> 2), u2 AS (SELECT DISTINCT k FROM calls WHERE element = {_m_of('2')}), s2 AS (SELECT k FROM java WHERE up = 2 AND k % 3 = 2)
 SELECT 'P2' AS "of", coalesce(u1.k, s1.k) AS path, u1.k IS NOT NULL AS usage, CASE WHEN s1.k IS NULL THEN '' ELSE 'shop.p.P' || s1.k END AS subtypes, '' AS overriders FROM u1 FULL OUTER JOIN s1 ON u1.k = s1.k
 UNION ALL SELECT 'm2', coalesce(u2.k, s2.k), u2.k IS NOT NULL, '', CASE WHEN s2.k IS NULL THEN '' ELSE 'shop.p.P' || s2.k END FROM u2 FULL OUTER JOIN s2 ON u2.k = s2.k""",
    "q54_typed_search": f"""WITH RECURSIVE {_JAVA}, {_ABOVE}, f AS (SELECT k, t, 1 + CASE WHEN even THEN 1 ELSE 0 END + CASE WHEN fifth THEN 1 ELSE 0 END AS freq FROM java)
 SELECT k AS path, 'Usage of isEmpty' AS pattern, 'Serializable' AS required, freq FROM f WHERE EXISTS (SELECT 1 FROM above x WHERE x.k IN (f.k, f.t) AND x.a % 5 = 0) UNION ALL SELECT k, 'Usage of isEmpty', 'Collection, CharSequence', freq FROM f""",
    "q55_rule_spans": f"""WITH {_JAVA}, {_HITS} SELECT k AS path, string_agg(start_off || ':' || (start_off + n), ':' ORDER BY start_off) AS spans FROM hits WHERE label = 'Usage of isEmpty' GROUP BY 1""",
    "q56_carets": f"""WITH {_JAVA} SELECT k AS path, strpos(content, 'class P') + 5 AS position, 'CLASS:shop.p.P' || k AS element, 'CLASS' AS kind, true AS declaration, strpos(content, 'public class') - 1 AS target FROM java
 UNION ALL SELECT k, strpos(content, '.size()'), 'METHOD:java.util.Collection:size:()I', 'METHOD', false, -2 FROM java UNION ALL SELECT k, 9, 'PACKAGE:shop', 'PACKAGE', false, -2 FROM java""",
    "q57_declaration_spans": f"""WITH {_JAVA}, m AS (SELECT k, content, {_m_of('k')} AS element, m_text AS body, 'm' || j AS name FROM java UNION ALL SELECT k, content, 'METHOD:shop.p.P' || k || ':pick:' || {_PICK}, pick_text, 'pick' FROM java WHERE even UNION ALL SELECT k, content, 'METHOD:shop.p.P' || k || ':call:(Lshop/p/P' || t || ';)V', call_text, 'call' FROM java
 UNION ALL SELECT k, content, {_next_of('k')}, next_text, 'next' FROM java WHERE derived UNION ALL SELECT k, content, 'METHOD:shop.p.P' || k || '$In:e:()Z', ' boolean e() {{ return s.isEmpty(); }}', 'e' FROM java WHERE fifth),
 p AS (SELECT *, strpos(content, body) AS a, strpos(content, body) - 1 + length(body) AS b, strpos(content, body) - 1 + strpos(body, ' ' || name || '(') AS c FROM m) SELECT k AS path, element, a || ':' || b || ':' || c || ':' || (c + length(name)) AS name_span FROM p""",
    "q58_sources_of_types": f"""WITH {_JAVA} SELECT 's' || j AS segment, 'shop.p.P' || k AS name, CAST(k AS VARCHAR) AS paths FROM java UNION ALL SELECT 's' || j, 'shop.p.P' || k || '$In', CAST(k AS VARCHAR) FROM java WHERE fifth""",
    "q59_element_names": f"""WITH {_FEATURES}, c AS (SELECT *, CASE WHEN kind = 'METHOD' THEN 'METHOD:' || class_fqn || ':' || simple_name || ':(I[J)V' WHEN kind IN ('CLASS', 'INTERFACE') THEN kind || ':' || class_fqn ELSE kind || ':' || class_fqn || ':' || simple_name END AS client FROM features)
 SELECT decl_pos, client, CASE WHEN kind = 'METHOD' THEN simple_name || '(int, long[]) in ' || class_fqn WHEN kind IN ('CLASS', 'INTERFACE') THEN class_fqn ELSE simple_name || ' in ' || class_fqn END AS shown, regexp_replace(client, '^(CLASS|INTERFACE|METHOD):', '') AS stripped FROM c""",
    "q60_rule_texts": f"""WITH {_FEATURES}, w AS (SELECT *, list_filter([CASE WHEN is_public THEN '$1 instanceof ' || class_fqn END, CASE WHEN is_static THEN '$a instanceof int' END], lambda x: x IS NOT NULL) AS c FROM features)
 SELECT decl_pos, CASE WHEN NOT is_private THEN '$1.' || simple_name || '($a$)' || CASE WHEN len(c) > 0 THEN ' :: ' || array_to_string(c, ' && ') ELSE '' END || ';;' || chr(10) END AS rule, simple_name || '%26a%20b/c?d=e:' || class_fqn AS escaped FROM w""",
    "q61_token_colours": f"""WITH {_PIECES}, t AS (SELECT path, offset_, offset_ + part % 12 + 1 AS e, part FROM tokens) SELECT path, offset_ AS "offset", e - coalesce(lag(e) OVER (PARTITION BY path ORDER BY offset_), 0) AS span, trim(['keyword', 'markup-element', 'identifier', ''][part % 4 + 1] || CASE WHEN part % 3 = 0 THEN ' static public' ELSE '' END) AS category FROM t""",
    "q62_highlights": f"""WITH {_PIECES}, h AS (SELECT l_orderkey AS path, min(l_partkey) % 20 + 20 AS h_end FROM lineitem GROUP BY 1), t AS (SELECT path, offset_ AS s, offset_ + 12 AS e, h_end, least(greatest(18, offset_), offset_ + 12) AS a0, greatest(least(h_end, offset_ + 12), offset_) AS b0 FROM tokens JOIN h USING (path)),
 x AS (SELECT *, 18 < e AND h_end > s AS met FROM t), p AS (SELECT path, s, s AS a, CASE WHEN met THEN a0 ELSE e END AS b, 'plain' AS category FROM x UNION ALL SELECT path, s, a0, b0, 'plain highlight' FROM x WHERE met UNION ALL SELECT path, s, b0, e, 'plain' FROM x WHERE met)
 SELECT path, a AS start, substr('abcdefghijkl', CAST(a - s + 1 AS INTEGER), CAST(b - a AS INTEGER)) AS text, category FROM p WHERE b > a""",
    "q63_resource_expressions": f"""WITH {_SIGNED} SELECT decl_pos, replace(class_fqn, '.', '[.-]') || CASE WHEN kind IN ('METHOD', 'FIELD', 'ENUM_CONSTANT') THEN '[.-]' || simple_name ELSE '' END AS expression FROM signed""",
    "q64_paths_and_owners": f"""WITH {_SOURCES}, folders AS (SELECT DISTINCT concat_ws('/', segment, mime) AS folder FROM sources) SELECT relative_path AS path, '/home/' || relative_path AS local_file, 'root:' || folder AS root FROM sources JOIN folders ON relative_path = folder OR starts_with(relative_path, folder || '/') WHERE size_bytes > 1000 UNION ALL SELECT relative_path, NULL, NULL FROM sources WHERE size_bytes IS NULL OR size_bytes <= 1000""",
    "q65_given_hashes": f"""WITH {_SINGLE}, d AS (SELECT DISTINCT hash, path FROM single), low AS (SELECT DISTINCT hash FROM d WHERE path < 100), f AS (SELECT hash, path FROM d WHERE path < 100 UNION ALL SELECT hash, path FROM d WHERE path >= 100 AND hash NOT IN (SELECT hash FROM low)) SELECT hash, count(*) AS n_paths, min(path) AS first FROM f GROUP BY 1""",
    "q66_compiler_severity": f"WITH {_DIAGNOSED} SELECT CASE severity WHEN 'error' THEN 'ERROR' WHEN 'warning' THEN 'WARNING' ELSE 'NOTE' END AS severity, count(*) AS n FROM h GROUP BY 1",
    "q67_batch": "SELECT 's' || (p_partkey % 3) AS \"group\", 'SUCCESS' AS status FROM part WHERE p_partkey % 3 IN (0, 2) GROUP BY 1",
    "q52_clones": f"""WITH {_JAVA}, c AS (SELECT count(*) AS n, count(*) FILTER (even) AS e, count(*) FILTER (fifth) AS f FROM java), p AS (SELECT t, count(*) AS n FROM java GROUP BY 1 HAVING count(*) >= 2)
 SELECT 28 AS value, n AS n_files, n AS n_spans, 1 AS n_groups FROM c UNION ALL SELECT 11, n, n, 1 FROM c UNION ALL SELECT 27, e, e, 1 FROM c UNION ALL SELECT 13, f, f, 1 FROM c UNION ALL SELECT 17, n, n, count(*) FROM p GROUP BY n""",
    "q68_relative_paths": f"WITH {_SOURCES}, p AS (SELECT CASE WHEN size_bytes % 2 = 0 THEN '/w/src/' ELSE '/x/' END || relative_path AS path FROM sources) SELECT path, starts_with(path, '/w/src/') AS below, regexp_replace(path, '^/w/src/', '') AS relative, regexp_replace(path, '^/w/src/', 'rel:/') AS moved, path AS back FROM p",
    "q69_symbol_rows": f"""WITH {_JAVA}, r AS (SELECT k, 'P' || k AS o, 'next' AS n, '()Lshop/p/P' || up || ';' AS d, 'METHOD' AS kind, '' AS m FROM java WHERE derived UNION ALL SELECT k, 'P' || k, 'count' || j, NULL, 'FIELD', '"PRIVATE"' FROM java UNION ALL SELECT k, 'P' || k, 'items', NULL, 'FIELD', '"PRIVATE"' FROM java UNION ALL SELECT k, 'P' || k || '$In', 's', NULL, 'FIELD', '' FROM java WHERE fifth)
 SELECT k AS path, '{{"file":"' || k || '","enclosingFQN":"shop.p.' || o || '","simpleName":"' || n || '"' || CASE WHEN d IS NULL THEN '' ELSE ',"vmsignature":"' || d || '"' END || ',"kind":"' || kind || '","modifiers":[' || m || ']}}' AS row FROM r""",
    "q70_listed": f"WITH {_SOURCES} SELECT segment AS project, relative_path AS file, row_number() OVER (PARTITION BY segment ORDER BY relative_path) AS place FROM sources",
    "q71_extractors": f"""WITH {_JAVA} SELECT 'imports' AS extractor, k AS path, 'import' AS key, 'java.util.List' AS value FROM java UNION ALL SELECT 'sizes', k, 'lines', CAST(length(content) - length(replace(content, chr(10), '')) AS VARCHAR) FROM java UNION ALL SELECT 'sizes', k, 'characters', CAST(length(content) AS VARCHAR) FROM java""",
}
