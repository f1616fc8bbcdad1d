"""Knowledge text queries over `documents`: cleaning, audit, sections, chunks, masking."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchfold.functions import ids, jsonwalk
from watchfold.operators import text as X
from watchfold.plans.registry import query
from watchfold.sources.tables import load

KEY = b"fixed-test-key"


def records(spark, sf):
    """A source is a document, each of its texts a record."""
    d = load(spark, sf, "documents")
    return d.select(F.col("source").alias("document_id"), F.col("doc_id").alias("record_id"), F.col("doc_id").alias("page"), F.col("doc_id").alias("record_order"), "text")


BREAKS = r"(\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{0085}\x{2028}\x{2029}])"
NORM = r"trim(regexp_replace({x}, '\s+', ' ', 'g'))"
REC = rf"""WITH rec AS (SELECT source AS document_id, doc_id AS record_id, text FROM documents),
ln AS (SELECT document_id, record_id, unnest(string_split_regex(regexp_replace(text, '{BREAKS}\z', ''), '{BREAKS}')) AS line FROM rec), nl AS (SELECT document_id, record_id, {NORM.format(x='line')} AS line FROM ln),
tot AS (SELECT document_id, count(*) AS records FROM rec GROUP BY 1), cnt AS (SELECT document_id, line, count(DISTINCT record_id) AS n FROM nl WHERE length(line) >= 8 GROUP BY 1, 2),
rep AS (SELECT document_id, line, n FROM cnt JOIN tot USING (document_id) WHERE records >= 3 AND n >= greatest(3, floor(records * 0.2)) AND length(line) <= 140)"""




@query("repeated_lines", REC + " SELECT document_id, line, n FROM rep")
def repeated_lines(spark, sf):
    return X.repeated_lines(tagged(spark, sf, False))


def tagged(spark, sf, footer=True):
    r = records(spark, sf)
    return r.withColumn("text", F.concat("text", F.lit("\nPage  footer of "), "document_id")) if footer else r


@query("header_lines_removed", REC.replace("doc_id AS record_id, text FROM", "doc_id AS record_id, text || chr(10) || 'Page  footer of ' || source AS text FROM") +
       ", hit AS (SELECT record_id, count(*) AS removed_lines FROM nl WHERE EXISTS (SELECT 1 FROM rep WHERE rep.document_id = nl.document_id AND rep.line = nl.line) GROUP BY 1), kept AS (SELECT record_id, sum(length(line)) AS kept_chars FROM nl WHERE NOT EXISTS (SELECT 1 FROM rep WHERE rep.document_id = nl.document_id AND rep.line = nl.line) GROUP BY 1)"
       " SELECT rec.record_id, coalesce(removed_lines, 0)::INT AS removed_lines, coalesce(kept_chars, 0)::BIGINT AS kept_chars FROM rec LEFT JOIN hit USING (record_id) LEFT JOIN kept USING (record_id)")
def header_lines_removed(spark, sf):
    r = tagged(spark, sf)
    out = X.remove_repeated_lines(r, X.repeated_lines(r))
    chars = F.aggregate(F.transform(X.lines(F.col("text")), lambda l: F.length(X.normalize_line(l)).cast("long")), F.lit(0).cast("long"), lambda a, n: a + n)
    return out.select("record_id", "removed_lines", chars.alias("kept_chars"))


@query("hyphen_breaks_joined", r"""WITH t AS (SELECT doc_id, regexp_replace(text, ' (th|en|er)', '-' || chr(10) || ' \1', 'g') AS t FROM documents)
 SELECT doc_id, len(regexp_extract_all(t, '[A-Za-z]-[ \t]*\n[ \t]*[A-Za-z]'))::INT AS joined, md5(regexp_replace(t, '([A-Za-z])-[ \t]*\n[ \t]*([A-Za-z])', '\1\2', 'g')) AS text_md5 FROM t""")
def hyphen_breaks_joined(spark, sf):
    t = load(spark, sf, "documents").select("doc_id", F.regexp_replace("text", " (th|en|er)", "-\n $1").alias("t"))
    return t.select("doc_id", X.hyphen_breaks(F.col("t")).alias("joined"), F.md5(X.dehyphenate(F.col("t"))).alias("text_md5"))


@query("mojibake_repaired", """WITH t AS (SELECT doc_id, replace(replace(replace(text, 'é', 'â€™'), 'ü', 'â€œ'), ', ', ' â€“ ') AS t FROM documents), c AS (SELECT doc_id, t, ((length(t) - length(replace(t, 'â€™', ''))) // 3 + (length(t) - length(replace(t, 'â€œ', ''))) // 3 + (length(t) - length(replace(t, 'â€“', ''))) // 3)::INT AS repairs FROM t)
 SELECT doc_id, repairs, md5(replace(replace(replace(t, 'â€™', ''''), 'â€œ', '"'), 'â€“', '-')) AS text_md5 FROM c""")
def mojibake_repaired(spark, sf):
    damage = lambda t: F.replace(F.replace(F.replace(t, F.lit("é"), F.lit("â€™")), F.lit("ü"), F.lit("â€œ")), F.lit(", "), F.lit(" â€“ "))
    t = load(spark, sf, "documents").select("doc_id", damage(F.col("text")).alias("t"))
    return t.select("doc_id", X.mojibake_count(F.col("t")).alias("repairs"), F.md5(X.repair_mojibake(F.col("t"))).alias("text_md5"))


@query("whitespace_normalised", r"""WITH t AS (SELECT doc_id, replace(replace(text, '. ', ' ' || chr(9) || '.  ' || chr(10) || chr(10) || ' ' || chr(10)), ', ', '  ,   ') AS t FROM documents)
 SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10))) AS text_md5 FROM t""")
def whitespace_normalised(spark, sf):
    t = F.replace(F.replace(F.col("text"), F.lit(". "), F.lit(" \t.  \n\n \n")), F.lit(", "), F.lit("  ,   "))
    return load(spark, sf, "documents").select("doc_id", F.md5(X.normalize_whitespace(t)).alias("text_md5"))


def pages(spark, sf):
    """Pages of a source, each opening with a section heading that changes every ten pages of the source."""
    d = load(spark, sf, "documents")
    return d.select(F.col("source").alias("document_id"), F.col("doc_id").alias("page"),
                    F.concat(F.lit("intro \n§ 1910."), F.expr("100 + (doc_id div 20) div 10"), F.lit(" Heading "), "text").alias("text"))


@query("section_trim", """WITH p AS (SELECT source AS document_id, doc_id AS page, 100 + (doc_id // 20) // 10 AS sec, 'intro ' || chr(10) || '§ 1910.' || (100 + (doc_id // 20) // 10) || ' Heading ' || text AS text FROM documents),
 s AS (SELECT document_id, min(page) AS sp FROM p WHERE sec = 102 GROUP BY 1), e AS (SELECT p.document_id, min(page) AS ep FROM p JOIN s USING (document_id) WHERE page > sp AND sec <> 102 GROUP BY 1)
 SELECT p.document_id, page, CASE WHEN page = sp THEN 7 ELSE 0 END AS cut_before, CASE WHEN page = ep THEN length(text) - 7 ELSE 0 END::INT AS cut_after, md5(CASE WHEN page = sp THEN substr(text, 8) WHEN page = ep THEN substr(text, 1, 7) ELSE text END) AS text_md5
 FROM p LEFT JOIN s USING (document_id) LEFT JOIN e USING (document_id) WHERE sp IS NULL OR (page >= sp AND (ep IS NULL OR page <= ep))""")
def section_trim(spark, sf):
    return X.trim_to_section(pages(spark, sf), "102").select("document_id", "page", "cut_before", "cut_after", F.md5("text").alias("text_md5"))


@query("control_text", """WITH p AS (SELECT source AS document_id, doc_id AS page, doc_id // 20 AS i, 'PE-' || ((doc_id // 20) // 2) || ' CONTROL ' || text AS text FROM documents)
 SELECT document_id, page, md5(text) AS text_md5 FROM p WHERE i = 6""")
def control_text(spark, sf):
    """Two pages open with each control number; the text of PE-3 ends at the very next heading."""
    d = load(spark, sf, "documents")
    p = d.select(F.col("source").alias("document_id"), F.col("doc_id").alias("page"), F.concat(F.lit("PE-"), F.expr("(doc_id div 20) div 2"), F.lit(" CONTROL "), "text").alias("text"))
    out = X.trim_to_section(p, "3", X.CONTROL_HEADING, stop_at_any=True)
    return out.where("text <> ''").select("document_id", "page", F.md5("text").alias("text_md5"))


@query("replacement_contexts", """WITH t AS (SELECT doc_id, replace(text, 'ä', chr(65533)) AS t FROM documents),
 c AS (SELECT doc_id, len(t) - len(replace(t, chr(65533), '')) AS n, regexp_extract_all(t, '(?s).{0,60}' || chr(65533) || '.{0,60}') AS x FROM t)
 SELECT doc_id, n AS replacement_characters, unnest(x) AS context, unnest(range(len(x)))::INT AS place FROM c""")
def replacement_contexts(spark, sf):
    t = load(spark, sf, "documents").select("doc_id", F.replace("text", F.lit("ä"), F.lit("\ufffd")).alias("t"))
    counted = t.withColumn("replacement_characters", F.regexp_count("t", F.lit("\ufffd")).cast("long"))
    return counted.select("doc_id", "replacement_characters", F.posexplode(X.replacement_contexts(F.col("t"))).alias("place", "context"))


@query("corpus_audit", REC + r""", rep2 AS (SELECT document_id, count(*) AS repeated_lines FROM cnt JOIN tot USING (document_id) WHERE n >= greatest(3, floor(records * 0.2)) GROUP BY 1),
 g AS (SELECT document_id, count(*) AS record_count, sum(length(text))::BIGINT AS total_characters, min(length(text))::INT AS min_characters, max(length(text))::INT AS max_characters, count(*) FILTER (length(text) < 80) AS short_records, count(*) FILTER (length(text) > 12000) AS long_records,
  count(*) - count(DISTINCT sha256(text)) AS duplicate_records, sum(len(regexp_extract_all(text, '[A-Za-z]-\n[A-Za-z]')))::BIGINT AS hyphen_breaks FROM rec GROUP BY 1)
 SELECT g.*, coalesce(repeated_lines, 0) AS repeated_lines, CASE WHEN short_records / record_count::DOUBLE > 0.05 OR long_records + coalesce(repeated_lines, 0) + duplicate_records + hyphen_breaks > 0 THEN 'REVIEW' ELSE 'PASS' END AS status FROM g LEFT JOIN rep2 USING (document_id)""")
def corpus_audit(spark, sf):
    return X.audit(records(spark, sf)).drop("replacement_characters", "nul_characters")


SPOILT = r"""(SELECT source || '-' || lang AS source, doc_id, CASE WHEN lang = 'de' AND doc_id % 7 = 0 THEN text || chr(0) WHEN lang = 'fr' AND doc_id % 5 = 0 THEN chr(65533) || text ELSE text END AS text FROM documents)"""


@query("corpus_audit_defects", REC.replace("FROM documents", "FROM " + SPOILT) + r""", rep2 AS (SELECT document_id, count(*) AS repeated_lines FROM cnt JOIN tot USING (document_id) WHERE n >= greatest(3, floor(records * 0.2)) GROUP BY 1),
 g AS (SELECT document_id, count(*) AS record_count, count(*) FILTER (length(text) < 80) AS short_records, count(*) FILTER (length(text) > 12000) AS long_records, count(*) - count(DISTINCT sha256(text)) AS duplicate_records,
  sum(length(text) - length(replace(text, chr(65533), '')))::BIGINT AS replacement_characters, sum(length(text) - length(replace(text, chr(0), '')))::BIGINT AS nul_characters,
  sum(len(regexp_extract_all(text, '[A-Za-z]-\n[A-Za-z]')))::BIGINT AS hyphen_breaks FROM rec GROUP BY 1)
 SELECT document_id, record_count, replacement_characters, nul_characters, coalesce(repeated_lines, 0) AS repeated_lines, CASE WHEN nul_characters > 0 THEN 'FAIL'
  WHEN short_records / record_count::DOUBLE > 0.05 OR long_records + coalesce(repeated_lines, 0) + duplicate_records + replacement_characters + hyphen_breaks > 0 THEN 'REVIEW' ELSE 'PASS' END AS status FROM g LEFT JOIN rep2 USING (document_id)""")
def corpus_audit_defects(spark, sf):
    """Each source and language a document; NUL and replacement characters are planted into the given texts, so that FAIL is reached."""
    text = F.when((F.col("lang") == "de") & (F.col("doc_id") % 7 == 0), F.concat("text", F.lit("\0"))).when((F.col("lang") == "fr") & (F.col("doc_id") % 5 == 0), F.concat(F.lit("\ufffd"), "text")).otherwise(F.col("text"))
    d = load(spark, sf, "documents").select(F.concat("source", F.lit("-"), "lang").alias("document_id"), F.col("doc_id").alias("record_id"), F.col("doc_id").alias("page"), F.col("doc_id").alias("record_order"), text.alias("text"))
    return X.audit(d).select("document_id", "record_count", "replacement_characters", "nul_characters", "repeated_lines", "status")


@query("paragraph_pieces", r"""WITH p AS (SELECT doc_id, unnest(string_split_regex(regexp_replace(text, '\.\n([A-Z0-9])', '.' || chr(1) || '\1', 'g'), '\n\s*\n|' || chr(1))) AS p FROM documents), n AS (SELECT doc_id, trim(regexp_replace(p, '\s+', ' ', 'g')) AS p FROM p),
 w AS (SELECT doc_id, len(string_split(p, ' ')) AS words FROM n WHERE p <> '') SELECT doc_id, CAST(sum((words + 999) // 1000) AS BIGINT) AS units, CAST(sum(words) AS BIGINT) AS words FROM w GROUP BY 1""")
def paragraph_pieces(spark, sf):
    return X.units(records(spark, sf)).groupBy(F.col("record_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("units"), F.sum("words").alias("words"))


def chunks(spark, sf):
    r = records(spark, sf).withColumn("document_id", F.col("record_id").cast("string")).withColumn("page", F.col("page").cast("int")).withColumn("record_id", F.col("record_id").cast("string"))
    return X.chunk(r)


@query("knowledge_chunks")
def knowledge_chunks(spark, sf):
    """Sequential fold per document; checked against a brute-force fold in the tests."""
    return chunks(spark, sf).select("chunk_id", "document_id", "chunk_index", "word_count", F.sha2("text", 256).alias("text_sha"))


@query("index_integrity", """WITH c AS (SELECT doc_id AS id FROM documents UNION ALL SELECT doc_id FROM labels WHERE toxic = 1 AND quality = 1), v AS (SELECT doc_id AS id FROM labels WHERE quality = 1 UNION ALL SELECT vec_id + 1000000 FROM embeddings)
 SELECT id AS chunk_id, 'CHUNK_WITHOUT_VECTOR' AS problem FROM (SELECT DISTINCT id FROM c) WHERE id NOT IN (SELECT id FROM v) UNION ALL SELECT id, 'VECTOR_WITHOUT_CHUNK' FROM (SELECT DISTINCT id FROM v) WHERE id NOT IN (SELECT id FROM c) UNION ALL SELECT id, 'DUPLICATE_CHUNK' FROM c GROUP BY id HAVING count(*) > 1""")
def index_integrity(spark, sf):
    lab = load(spark, sf, "labels")
    one = lambda df, c: df.select(F.expr(c).alias("chunk_id"))
    c = one(load(spark, sf, "documents"), "doc_id").unionByName(one(lab.where("toxic = 1 AND quality = 1"), "doc_id"))
    v = one(lab.where("quality = 1"), "doc_id").unionByName(one(load(spark, sf, "embeddings"), "vec_id + 1000000"))
    return X.index_integrity(c, v)


@query("eligible_sources", """SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(quality, 1) = 1 AND coalesce(toxic, 0) = 0 AND lang IN ('en', 'de') AND source = 'src1'""")
def eligible_sources(spark, sf):
    d = load(spark, sf, "documents").join(load(spark, sf, "labels"), "doc_id", "left")
    s = d.select("doc_id", F.when(F.coalesce("quality", F.lit(1)) == 1, "APPROVED").otherwise("REJECTED").alias("approval_status"), F.when(F.coalesce("toxic", F.lit(0)) == 0, "ACTIVE").otherwise("RETIRED").alias("retrieval_status"),
                 F.array("lang").alias("applicable_domains"), F.col("source").alias("authority_type"), F.lit("GUIDE").alias("source_type"))
    return X.eligible_sources(s, ["EN", "DE"], authority="src1", source_type="GUIDE").select("doc_id")


def _hmac_sql(prefix, value):
    block = KEY.ljust(64, b"\0")
    ipad, opad = bytes(b ^ 0x36 for b in block).hex(), bytes(b ^ 0x5C for b in block).hex()
    return f"'{prefix}-' || upper(substr(sha256(unhex('{opad}') || unhex(sha256(unhex('{ipad}') || encode('{prefix}:' || {value})))), 1, 10))"


@query("pseudonyms", f"SELECT event_id, {_hmac_sql('USER', 'user_id')} AS user_token, CASE WHEN event_type = 'view' THEN 'UNKNOWN' ELSE {_hmac_sql('PERSON', 'event_type')} END AS person_token FROM events")
def pseudonyms(spark, sf):
    e = load(spark, sf, "events")
    return e.select("event_id", ids.pseudonym(KEY, "USER", F.col("user_id").cast("string")).alias("user_token"),
                    ids.pseudonym(KEY, "PERSON", F.when(F.col("event_type") == "view", "UNKNOWN").otherwise(F.col("event_type"))).alias("person_token"))


@query("masked_text", r"""SELECT doc_id, len(regexp_extract_all(text, '\b(?:\d{1,3}\.){3}\d{1,3}\b'))::INT AS addresses, md5(regexp_replace(regexp_replace(text, '\b(?:\d{1,3}\.){3}\d{1,3}\b', '<ip>', 'g'), '\bP\d{3,8}\b', '<person>', 'g')) AS shape_md5 FROM documents""")
def masked_text(spark, sf):
    m = load(spark, sf, "documents").select("doc_id", F.regexp_count("text", F.lit(ids.IPV4_WORD)).alias("addresses"), ids.mask_text(KEY, F.col("text")).alias("m"))
    shape = F.regexp_replace(F.regexp_replace("m", r"\bIP-[0-9A-F]{10}\b", "<ip>"), r"\bPERSON-[0-9A-F]{10}\b", "<person>")
    return m.select("doc_id", "addresses", F.md5(shape).alias("shape_md5"))


@query("token_table", r"WITH m AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\b(?:\d{1,3}\.){3}\d{1,3}\b')) AS original FROM documents), p AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\bP\d{3,8}\b')) AS original FROM documents) SELECT " + _hmac_sql("IP", "original") + " AS token, original FROM m UNION ALL SELECT " + _hmac_sql("PERSON", "original") + ", original FROM p")
def token_table(spark, sf):
    return ids.token_table(KEY, load(spark, sf, "documents"), "text")


RECORD_JSON = """concat('{"source_ip": "10.1.2.', user_id, '", "usernames" : ["user', user_id, '",["UNKNOWN", "al"], {"text":"for user', user_id, '"}],\n "note":"user', user_id, ' at 10.1.2.', user_id,
 ' met P00', event_id, ' \\\\u00e9\\\\n", "n":1.500, "ip":', event_id, ', "deep":[{"person_id":"P', event_id, '","user":null}], "value":"user', user_id, '7"}')"""


@query("masked_records", f"""SELECT event_id, '{{"source_ip": "' || {_hmac_sql('IP', "'10.1.2.' || user_id")} || '", "usernames" : ["' || {_hmac_sql('USER', "'user' || user_id")} || '",["UNKNOWN", "'
 || {_hmac_sql('USER', "'al'")} || '"], {{"text":"for ' || {_hmac_sql('USER', "'user' || user_id")} || '"}}],' || chr(10) || ' "note":"' || {_hmac_sql('USER', "'user' || user_id")} || ' at ' || {_hmac_sql('IP', "'10.1.2.' || user_id")}
 || ' met ' || CASE WHEN event_id < 1000000 THEN {_hmac_sql('PERSON', "'P00' || event_id")} ELSE 'P00' || event_id END || ' \\u00e9\\n", "n":1.500, "ip":' || event_id || ', "deep":[{{"person_id":"' || {_hmac_sql('PERSON', "'P' || event_id")}
 || '","user":null}}], "value":"user' || user_id || '7"}}' AS record FROM events""")
def masked_records(spark, sf):
    """Nested records with identifiers under their keys, in lists and in free text."""
    return load(spark, sf, "events").select("event_id", F.expr(RECORD_JSON).alias("t")).select("event_id", jsonwalk.mask_values(F.col("t"), KEY).alias("record"))
