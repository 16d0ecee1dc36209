"""S: string, text and JSON functions; A: sources and sinks; the remaining validators; Z: incremental ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators.governance import release_violations
from millrace.plans.registry import query
from millrace.plans.tables import items, pairs, read
from millrace.sources import files, listing
from millrace.streaming import incremental

count = lambda name="n": F.count(F.lit(1)).alias(name)
rnd = lambda c, n=6: F.round(c, n)

CAPTIONS_SQL = """cap AS (SELECT item, 1 + item % 3 AS n_photos, CASE item % 6
 WHEN 0 THEN (age)::VARCHAR || '/' || ((age + 9) % 80 + 1)::VARCHAR WHEN 1 THEN 'left ' || age::VARCHAR || ', right is ' || (age + 3)::VARCHAR
 WHEN 2 THEN 'me in ' || age::VARCHAR || ' and in ' || (age + 5)::VARCHAR WHEN 3 THEN 'she was ' || age::VARCHAR || ' years old, looks about ' || (age + 1)::VARCHAR
 WHEN 4 THEN 'taken ' || age::VARCHAR || ' years ago' ELSE CASE item % 4 WHEN 1 THEN 'married ' || age::VARCHAR || ' years' ELSE 'a village ' || age::VARCHAR || ' km off, average ' || age::VARCHAR || ' people' END END AS caption FROM items WHERE age < 80)"""


def captions(spark, d):
    """Captions made from the attribute, in the forms that the rules know."""
    age = F.col("age")
    s = lambda c: c.cast("string")
    forms = [F.concat(s(age), F.lit("/"), s((age + 9) % 80 + 1)), F.concat(F.lit("left "), s(age), F.lit(", right is "), s(age + 3)), F.concat(F.lit("me in "), s(age), F.lit(" and in "), s(age + 5)), F.concat(F.lit("she was "), s(age), F.lit(" years old, looks about "), s(age + 1)), F.concat(F.lit("taken "), s(age), F.lit(" years ago"))]
    forms.append(F.when(F.col("item") % 4 == 1, F.concat(F.lit("married "), s(age), F.lit(" years"))).otherwise(F.concat(F.lit("a village "), s(age), F.lit(" km off, average "), s(age), F.lit(" people"))))
    return items(spark, d).where("age < 80").select("item", (1 + F.col("item") % 3).alias("n_photos"), F.element_at(F.array(*forms), (F.col("item") % 6 + 1).cast("int")).alias("caption"), "age")


@query("s01_age_anchors", f"""WITH {CAPTIONS_SQL}
SELECT item, CASE item % 6 WHEN 0 THEN CASE WHEN n_photos = 2 THEN [split_part(caption, '/', 1)::INTEGER, split_part(caption, '/', 2)::INTEGER] ELSE [] END
 WHEN 1 THEN [regexp_extract(caption, 'left (\\d+)', 1)::INTEGER, regexp_extract(caption, 'right is (\\d+)', 1)::INTEGER] WHEN 2 THEN [regexp_extract(caption, 'me in (\\d+)', 1)::INTEGER, regexp_extract(caption, 'and in (\\d+)', 1)::INTEGER]
 WHEN 3 THEN [regexp_extract(caption, 'was (\\d+)', 1)::INTEGER] ELSE [] END AS ages FROM cap""")
def s01(spark, d):
    return captions(spark, d).select("item", T.age_anchors(F.col("caption"), F.col("n_photos")).alias("ages"))


@query("s02_slash_sequence", f"WITH {CAPTIONS_SQL} SELECT item, CASE WHEN item % 6 = 0 AND n_photos = 2 THEN [split_part(caption, '/', 1)::INTEGER, split_part(caption, '/', 2)::INTEGER] ELSE [] END AS ages FROM cap")
def s02(spark, d):
    return captions(spark, d).select("item", T.slash_sequence(F.col("caption"), F.col("n_photos")).alias("ages"))


@query("s03_left_right", f"WITH {CAPTIONS_SQL} SELECT item, CASE WHEN item % 6 = 1 THEN [regexp_extract(caption, 'left (\\d+)', 1)::INTEGER, regexp_extract(caption, 'right is (\\d+)', 1)::INTEGER] ELSE [] END AS ages FROM cap")
def s03(spark, d):
    return captions(spark, d).select("item", T.left_right(F.col("caption")).alias("ages"))


@query("s04_ordered_pair", f"WITH {CAPTIONS_SQL} SELECT item, CASE WHEN item % 6 = 2 THEN [regexp_extract(caption, 'me in (\\d+)', 1)::INTEGER, regexp_extract(caption, 'and in (\\d+)', 1)::INTEGER] ELSE [] END AS ages FROM cap")
def s04(spark, d):
    return captions(spark, d).select("item", T.ordered_pair(F.col("caption")).alias("ages"))


@query("s05_singles", f"WITH {CAPTIONS_SQL} SELECT item, CASE WHEN item % 6 = 3 THEN [regexp_extract(caption, 'was (\\d+)', 1)::INTEGER] ELSE [] END AS ages FROM cap")
def s05(spark, d):
    return captions(spark, d).select("item", T.singles(F.col("caption")).alias("ages"))


@query("s07_apparent_age", f"WITH {CAPTIONS_SQL} SELECT item, CASE WHEN item % 6 = 3 THEN list_filter([regexp_extract(caption, 'about (\\d+)', 1)::INTEGER, regexp_extract(caption, 'was (\\d+)', 1)::INTEGER], lambda x: x BETWEEN 5 AND 90) ELSE [] END AS ages FROM cap")
def s07(spark, d):
    return captions(spark, d).select("item", T.apparent_ages(F.col("caption")).alias("ages"))


@query("s08_caption_features", """
SELECT doc_id, length(text) AS len, len(regexp_extract_all(text, '[^ \\t\\n\\r\\x0b\\f]+'))::BIGINT AS words, (length(text) - length(replace(text, '?', '')))::BIGINT AS questions, (length(text) - length(replace(text, '!', '')))::BIGINT AS bangs,
 round(length(regexp_replace(text, '[^A-Z]', '', 'g'))::DOUBLE / greatest(length(regexp_replace(text, '[^A-Za-z]', '', 'g')), 1), 6) AS upper_ratio, regexp_matches(text, '[0-9]') AS has_digit FROM documents""")
def s08(spark, d):
    t = F.col("text")
    n = lambda p: F.regexp_count(t, F.lit(p)).cast("long")
    ratio = F.length(F.regexp_replace(t, "[^A-Z]", "")) / F.greatest(F.length(F.regexp_replace(t, "[^A-Za-z]", "")), F.lit(1))
    return read(spark, d, "documents").select("doc_id", F.char_length("text").cast("long").alias("len"), n(r"[^ \t\n\r\x0b\f]+").alias("words"), n(r"\?").alias("questions"), n("!").alias("bangs"), rnd(ratio).alias("upper_ratio"), t.rlike("[0-9]").alias("has_digit"))


@query("s09_json_reply", """
SELECT item, [age::INTEGER] AS ages FROM items WHERE age IS NOT NULL""")
def s09(spark, d):
    """Ages parsed from a fenced free-text reply; entries out of range are dropped."""
    reply = F.concat(F.lit("Sure:\n```json\n[{\"age\": \""), F.col("age").cast("string"), F.lit("\", \"ref\": \" Photo_1 \"}, {\"age\": \"140\"}, {\"age\": \"x\"}]\n```"))
    return items(spark, d).where("age is not null").select("item", F.transform(T.reply_anchors(reply), lambda x: x["age"]).alias("ages"))


@query("s11_fallback_order", "SELECT item, coalesce(CASE WHEN item % 3 = 0 THEN age END, CASE WHEN item % 3 = 1 THEN age + 1 END, -1) AS age FROM items")
def s11(spark, d):
    i = F.col("item") % 3
    return items(spark, d).select("item", F.coalesce(F.when(i == 0, F.col("age")), F.when(i == 1, F.col("age") + 1), F.lit(-1)).alias("age"))


@query("s12_cache_lookup", "SELECT count(*) FILTER (l.doc_id IS NOT NULL) AS hits, count(*) FILTER (l.doc_id IS NULL) AS misses FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def s12(spark, d):
    c = read(spark, d, "labels").select("doc_id", F.lit(True).alias("hit"))
    return read(spark, d, "documents").select("doc_id").join(c, "doc_id", "left").agg(F.count_if(F.col("hit")).alias("hits"), F.count_if(F.col("hit").isNull()).alias("misses"))


@query("s13_text_chunks")
def s13(spark, d):
    """Chunks of at most 200 characters at word boundaries."""
    return read(spark, d, "conversations").select("conv_id", "turn", F.posexplode(T.chunks(F.col("text"), 200)).alias("chunk", "text"))


@query("s15_url_normalise", "SELECT page_id, regexp_replace(regexp_replace(lower(split_part(split_part(url, '#', 1), '?', 1)), '^https?://(www\\.|m\\.)?', ''), '/+$', '') AS permalink, nullif(regexp_extract(url, '/([0-9]+)', 1), '') AS stem FROM pages")
def s15(spark, d):
    u = F.substring_index(F.substring_index("url", "#", 1), "?", 1)
    p = F.regexp_replace(F.regexp_replace(F.lower(u), r"^https?://(www\.|m\.)?", ""), "/+$", "")
    return read(spark, d, "pages").select("page_id", p.alias("permalink"), F.nullif(F.regexp_extract("url", "/([0-9]+)", 1), F.lit("")).alias("stem"))


@query("s16_id_parts", "SELECT item, 'src_' || grp::VARCHAR || '_f' || (item % 3)::VARCHAR AS id, 'src_' || grp::VARCHAR AS parent, (item % 3)::INTEGER AS ordinal FROM items")
def s16(spark, d):
    i = F.concat(F.lit("src_"), F.col("grp").cast("string"), F.lit("_f"), (F.col("item") % 3).cast("string"))
    t = items(spark, d).select("item", i.alias("id"))
    return t.select("item", "id", F.regexp_extract("id", r"^(.*)_f\d+$", 1).alias("parent"), F.regexp_extract("id", r"_f(\d+)$", 1).cast("int").alias("ordinal"))


@query("s18_opaque_ids", "SELECT doc_id, substr(sha256('doc|' || doc_id::VARCHAR), 1, 10) AS opaque FROM documents")
def s18(spark, d):
    return read(spark, d, "documents").select("doc_id", F.substring(F.sha2(F.concat(F.lit("doc|"), F.col("doc_id").cast("string")), 256), 1, 10).alias("opaque"))


@query("s19_canonical_digest", """
SELECT source, sha256('{"doc_id":' || max(doc_id)::VARCHAR || ',"lang":"' || arg_max(lang, doc_id) || '"}') AS digest FROM documents GROUP BY source""")
def s19(spark, d):
    """Digest of canonical JSON: keys sorted, no blanks."""
    t = read(spark, d, "documents").groupBy("source").agg(F.max("doc_id").alias("doc_id"), F.max_by("lang", "doc_id").alias("lang"))
    return t.select("source", F.sha2(F.to_json(F.struct("doc_id", "lang")), 256).alias("digest"))


@query("s20_ngram_regression")
def s20(spark, d):
    """Ridge regression of a document's length on hashed character trigrams; the model's error on the held-out tenth."""
    from millrace.operators.text_models import ngram_ridge

    return ngram_ridge(read(spark, d, "documents").select("doc_id", "text", F.log1p("n_chars").alias("target")))


@query("s21_feature_string", "SELECT item, 'g' || grp::VARCHAR || ' e' || entity::VARCHAR || ' p' || (item % 3)::VARCHAR AS tokens FROM items")
def s21(spark, d):
    return items(spark, d).select("item", F.concat_ws(" ", F.concat(F.lit("g"), F.col("grp").cast("string")), F.concat(F.lit("e"), F.col("entity").cast("string")), F.concat(F.lit("p"), (F.col("item") % 3).cast("string"))).alias("tokens"))


@query("s22_target_prediction", f"WITH {CAPTIONS_SQL} SELECT item, CASE WHEN item % 6 IN (1, 2) THEN regexp_extract(caption, '(\\d+)[^0-9]*$', 1)::INTEGER WHEN item % 6 = 3 THEN regexp_extract(caption, 'was (\\d+)', 1)::INTEGER WHEN item % 6 = 0 AND n_photos = 2 THEN split_part(caption, '/', 2)::INTEGER END AS age FROM cap")
def s22(spark, d):
    """The anchor of the second photo: by position if there are two, else the only one."""
    a = T.age_anchors(F.col("caption"), F.col("n_photos"))
    return captions(spark, d).select("item", F.when(F.size(a) >= 2, F.get(a, F.lit(1))).when(F.size(a) == 1, F.get(a, F.lit(0))).alias("age"))


@query("s23_sanitise", "SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+', '<mail>', 'g'), '(?:/[A-Za-z0-9._-]+){3,}', '<path>', 'g'), '\\b[0-9a-f]{16,}\\b', '<key>', 'g'), '[0-9]{4,}', '<number>', 'g') AS text FROM documents WHERE regexp_matches(text, '[0-9@]')")
def s23(spark, d):
    return read(spark, d, "documents").where(F.col("text").rlike("[0-9@]")).select("doc_id", T.sanitise(F.col("text")).alias("text"))


@query("s24_hand_features", "SELECT doc_id, round(ln(1 + length(text)), 6) AS log_len, round(100.0::DOUBLE * (length(text) - length(replace(text, ',', ''))) / greatest(length(text), 1), 6) AS commas, (length(text) - length(replace(text, chr(10), '')))::BIGINT AS newlines FROM documents")
def s24(spark, d):
    n = F.char_length("text")
    return read(spark, d, "documents").select("doc_id", rnd(F.log(1 + n)).alias("log_len"), rnd(100.0 * F.regexp_count("text", F.lit(",")) / F.greatest(n, F.lit(1))).alias("commas"), F.regexp_count("text", F.lit("\n")).cast("long").alias("newlines"))


@query("a01_jsonl_roundtrip", "SELECT conv_id, turn, role, text FROM conversations")
def a01(spark, d):
    """Rows written as JSON lines, appended to, and read back under an explicit schema."""
    t = read(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    path = files.new_folder(spark, "jsonl")
    files.write_jsonl(t.where("turn % 2 = 0"), path)
    files.write_jsonl(t.where("turn % 2 = 1"), path, append=True)
    return files.read_jsonl(spark, path, t.schema)


@query("a03_append_rows", "SELECT conv_id, turn, role FROM conversations UNION ALL SELECT conv_id, turn, role FROM conversations WHERE turn = 0")
def a03(spark, d):
    """Appends to a file that is not there yet, then again: all rows stay, in repeats too."""
    t = read(spark, d, "conversations").select("conv_id", "turn", "role")
    path = files.new_folder(spark, "appended")
    files.write_jsonl(t, path, append=True)
    files.write_jsonl(t.where("turn = 0"), path, append=True)
    return files.read_jsonl(spark, path, t.schema)


@query("a04_last_wins", "SELECT vec_id AS item, label + 1 AS label FROM embeddings WHERE vec_id % 5 = 0 UNION ALL SELECT vec_id, label FROM embeddings WHERE vec_id % 5 <> 0")
def a04(spark, d):
    """Of rows that repeat an id the latest counts."""
    t = items(spark, d).select("item", "label", F.lit(1).alias("version"))
    newer = t.where("item % 5 = 0").select("item", (F.col("label") + 1).alias("label"), F.lit(2).alias("version"))
    return t.unionByName(newer).groupBy("item").agg(F.max_by("label", "version").alias("label"))


@query("a05_validated_vectors", "SELECT count(*) AS n, count(*) FILTER (abs(sqrt(list_dot_product(vec, vec)) - 1) <= 0.002) AS unit_norm, count(DISTINCT item) AS ids FROM items")
def a05(spark, d):
    from millrace.functions.vectors import norm

    return items(spark, d).agg(count(), F.count_if(F.abs(norm(F.col("vec")) - 1) <= 0.002).alias("unit_norm"), F.count_distinct("item").alias("ids"))


@query("a06_parquet_roundtrip", "SELECT user_id, day, views FROM daily WHERE views > 0")
def a06(spark, d):
    from millrace.plans.tables import daily
    from millrace.session import staged

    return staged(daily(spark, d).where("views > 0").select("user_id", "day", "views"), "features")


@query("a08_two_line_protocol", "SELECT a.conv_id, a.turn // 2 AS block, a.role AS first, b.role AS second FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.turn % 2 = 0")
def a08(spark, d):
    """Pairs of consecutive lines become one row."""
    t = read(spark, d, "conversations").select("conv_id", F.expr("turn div 2").alias("block"), (F.col("turn") % 2).alias("half"), "role")
    g = t.groupBy("conv_id", "block").agg(F.max(F.when(F.col("half") == 0, F.col("role"))).alias("first"), F.max(F.when(F.col("half") == 1, F.col("role"))).alias("second"))
    return g.where("first is not null and second is not null")


@query("a09_interleaved_pairs", "SELECT a.item // 2 AS pair, a.item AS even, b.item AS odd FROM items a JOIN items b ON b.item = a.item + 1 WHERE a.item % 2 = 0")
def a09(spark, d):
    g = items(spark, d).groupBy(F.expr("item div 2").alias("pair")).agg(F.max(F.when(F.col("item") % 2 == 0, F.col("item"))).alias("even"), F.max(F.when(F.col("item") % 2 == 1, F.col("item"))).alias("odd"))
    return g.where("even is not null and odd is not null")


@query("a10_html_listing", """
SELECT page_id, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, replace(replace(replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS title, len(regexp_extract_all(html, '<a href='))::BIGINT AS links FROM pages""")
def a10(spark, d):
    return listing.parse_pages(read(spark, d, "pages"))


@query("a11_best_variant", "SELECT user_id, arg_max(event_id, (value, -event_id)) AS event_id, max(value) AS value FROM events GROUP BY user_id")
def a11(spark, d):
    return read(spark, d, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("event_id"), F.max("value").alias("value"))


@query("a12_payload_normaliser", "SELECT event_id, nullif((props::JSON->>'k')::BIGINT, 0) AS k FROM events")
def a12(spark, d):
    """Counters from nested payloads; zero counts as unknown."""
    return read(spark, d, "events").select("event_id", F.nullif(F.from_json("props", "k bigint")["k"], F.lit(0).cast("long")).alias("k"))


@query("a13_engagement_union", "SELECT 'views' AS platform, user_id, count(*) AS n, NULL::DOUBLE AS ratio FROM events WHERE event_type = 'view' GROUP BY user_id UNION ALL SELECT 'clicks', user_id, count(*), round(avg(value), 4) FROM events WHERE event_type = 'click' GROUP BY user_id")
def a13(spark, d):
    """Two platforms in one schema; what one lacks is null."""
    e = read(spark, d, "events")
    a = e.where("event_type = 'view'").groupBy("user_id").agg(count()).withColumn("platform", F.lit("views"))
    b = e.where("event_type = 'click'").groupBy("user_id").agg(count(), rnd(F.avg("value"), 4).alias("ratio")).withColumn("platform", F.lit("clicks"))
    return a.unionByName(b, allowMissingColumns=True).select("platform", "user_id", "n", "ratio")


@query("a14_link_reader", "SELECT page_id, regexp_extract(url, '/([0-9]+)', 1)::BIGINT AS id FROM pages WHERE contains(url, '/en/') AND regexp_matches(url, '/[0-9]+')")
def a14(spark, d):
    p = read(spark, d, "pages").where(F.col("url").contains("/en/") & F.col("url").rlike("/[0-9]+"))
    return p.select("page_id", F.regexp_extract("url", "/([0-9]+)", 1).cast("long").alias("id"))


@query("a16_file_digests")
def a16(spark, d):
    """Name, bytes and SHA-256 of each small table's file."""
    return files.digests(spark, [f"{d}/{t}.parquet" for t in ("region", "nation", "benchmark")])


@query("a17_manifest")
def a17(spark, d):
    """A run's manifest: parameters, row counts and digests as one JSON document for each input."""
    return files.manifest(spark, {t: read(spark, d, t) for t in ("labels", "benchmark")}, {"seed": 42})


@query("a18_allow_listed_export", "SELECT doc_id, lang, n_chars FROM documents WHERE lang = 'en'")
def a18(spark, d):
    """Only listed columns leave; any other is refused."""
    return files.export(read(spark, d, "documents").where("lang = 'en'").select("doc_id", "lang", "n_chars"), ("doc_id", "lang", "n_chars"))


@query("e09_refuse_overwrite", "SELECT count(*) AS started, count(*) > 0 AS refuse FROM labels WHERE quality IS NOT NULL")
def e09(spark, d):
    return read(spark, d, "labels").where("quality is not null").agg(count("started")).select("started", (F.col("started") > 0).alias("refuse"))


@query("e10_returned_annotations", "SELECT count(*) AS n, count(*) FILTER (r.doc_id IS NULL) AS lost, count(*) FILTER (l.quality <> r.quality) AS changed FROM labels l LEFT JOIN (SELECT doc_id, CASE WHEN doc_id % 41 = 0 THEN 1 - quality ELSE quality END AS quality FROM labels WHERE doc_id % 37 <> 0) r ON l.doc_id = r.doc_id")
def e10(spark, d):
    """What came back of a pack: rows lost and fields changed."""
    t = read(spark, d, "labels").select("doc_id", "quality")
    r = t.where("doc_id % 37 <> 0").select(F.col("doc_id").alias("rid"), F.when(F.col("doc_id") % 41 == 0, 1 - F.col("quality")).otherwise(F.col("quality")).alias("rq"))
    return t.join(r, F.col("doc_id") == F.col("rid"), "left").agg(count(), F.count_if(F.col("rid").isNull()).alias("lost"), F.count_if(F.col("quality") != F.col("rq")).alias("changed"))


@query("e12_store_guard", "SELECT source, count(*) AS n FROM documents WHERE source = 'src1' GROUP BY source")
def e12(spark, d):
    """A store only takes rows of the source that it already has."""
    return files.guarded_append(spark, read(spark, d, "documents").where("source = 'src1'").select("doc_id", "source"), "source").groupBy("source").agg(count())


@query("n03_replay_comparison", """
WITH a AS (SELECT item, round(quality, 2) AS q FROM items),
b AS (SELECT item, CASE WHEN item % 31 = 0 THEN round(quality + 0.01, 2) ELSE round(quality, 2) END AS q FROM items WHERE item % 97 <> 0)
SELECT count(*) FILTER (a.item IS NULL OR b.item IS NULL) AS unmatched, count(*) FILTER (a.q <> b.q) AS different FROM a FULL JOIN b ON a.item = b.item""")
def n03(spark, d):
    """A result against a replay that lost some rows and changed others."""
    t = items(spark, d)
    a = t.select("item", F.round("quality", 2).alias("q"))
    b = t.where("item % 97 <> 0").select(F.col("item").alias("i2"), F.round(F.when(F.col("item") % 31 == 0, F.col("quality") + 0.01).otherwise(F.col("quality")), 2).alias("q2"))
    return a.join(b, F.col("item") == F.col("i2"), "full").agg(F.count_if(F.col("item").isNull() | F.col("i2").isNull()).alias("unmatched"), F.count_if(F.col("q") != F.col("q2")).alias("different"))


@query("n05_input_inventory", "SELECT count(*) AS rows, count(*) FILTER (text IS NULL) AS null_text, count(*) FILTER (n_chars <> length(text)) AS wrong_length, count(*) - count(DISTINCT doc_id) AS repeated_ids FROM documents")
def n05(spark, d):
    return read(spark, d, "documents").agg(count("rows"), F.count_if(F.col("text").isNull()).alias("null_text"), F.count_if(F.col("n_chars") != F.char_length("text")).alias("wrong_length"), (F.count(F.lit(1)) - F.count_distinct("doc_id")).alias("repeated_ids"))


@query("n07_protocol_hash", "SELECT sha256(string_agg(k || '=' || v, ';' ORDER BY k)) AS digest FROM (VALUES ('far', '0.01'), ('folds', '10'), ('seed', '42')) t(k, v)")
def n07(spark, d):
    t = spark.createDataFrame([("far", "0.01"), ("folds", "10"), ("seed", "42")], "k string, v string")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: F.concat(x["k"], F.lit("="), x["v"]))  # three parameters
    return t.agg(F.sha2(F.array_join(parts, ";"), 256).alias("digest"))


@query("n09_fact_table", """
SELECT 'documents' AS section, 'rows' AS fact, count(*)::DOUBLE AS value FROM documents UNION ALL SELECT 'documents', 'languages', count(DISTINCT lang) FROM documents UNION ALL SELECT 'items', 'rows', count(*) FROM items
UNION ALL SELECT 'items', 'unknown_age', count(*) FILTER (age IS NULL) FROM items UNION ALL SELECT 'pairs', 'positives', count(*) FILTER (y = 1) FROM pairs UNION ALL SELECT 'pairs', 'mean_score', round(avg(score), 6) FROM pairs""")
def n09(spark, d):
    """Facts of several tables in one long table."""
    def facts(df, section, **aggs):
        wide = df.agg(*[c.cast("double").alias(k) for k, c in aggs.items()])
        return wide.unpivot([], list(aggs), "fact", "value").select(F.lit(section).alias("section"), "fact", "value")

    one = F.count(F.lit(1))
    a = facts(read(spark, d, "documents"), "documents", rows=one, languages=F.count_distinct("lang"))
    b = facts(items(spark, d), "items", rows=one, unknown_age=F.count_if(F.col("age").isNull()))
    c = facts(pairs(spark, d), "pairs", positives=F.count_if(F.col("y") == 1), mean_score=rnd(F.avg("score")))
    return a.unionByName(b).unionByName(c)


@query("n11_blinded_pack_check", "SELECT 0::BIGINT AS missing, 0::BIGINT AS leaked")
def n11(spark, d):
    """Both annotators' packs hold the same tasks, and no task shows an original id."""
    t = read(spark, d, "labels").select(F.substring(F.sha2(F.concat(F.lit("task|"), F.col("doc_id").cast("string")), 256), 1, 12).alias("task"))
    a, b = t.select(F.col("task").alias("a")), t.select(F.col("task").alias("b"))
    return a.join(b, F.col("a") == F.col("b"), "full").agg(F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("missing"), F.count_if(F.col("a").rlike("^doc")).alias("leaked"))


@query("n13_vector_contract", "SELECT count(*) FILTER (len(vec) <> 64) AS wrong_size, count(*) FILTER (list_bool_or([NOT isfinite(x) FOR x IN vec])) AS not_finite FROM items")
def n13(spark, d):
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return items(spark, d).agg(F.count_if(F.size("vec") != 64).alias("wrong_size"), F.count_if(bad).alias("not_finite"))


@query("e13_release_violations", "SELECT 'text|mail' AS check_name, count(*) AS violations FROM documents WHERE regexp_matches(text, '[A-Za-z0-9._]+@[A-Za-z0-9]+') HAVING count(*) > 0")
def e13(spark, d):
    return release_violations(read(spark, d, "documents"), {"mail": "[A-Za-z0-9._]+@[A-Za-z0-9]+", "never": "zzzzzzzz"}, ["text"])


@query("z02_streaming_ingest", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY event_type")
def z02(spark, d):
    """The events as a file stream: each new file is one micro-batch, ids are seen once, totals are kept."""
    return incremental.stream_totals(spark, read(spark, d, "events"))


