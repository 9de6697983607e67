"""Admission of deposits: key parsing, checks, deduplication, registry, mail rules, reference data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.operators.temporal import accepted  # noqa: F401  the temporal rule is admission's

#: Origins of deposits; any other is UNKNOWN.
ORIGINS = ("UI_IMPORT", "FTP", "S3", "API", "MAIL", "WS")
#: Mail headers that are kept.
HEADERS = ("from", "to", "cc", "subject", "date", "message-id", "reply-to")
TRUE_WORDS = ("true", "1", "yes", "on")


def parsed_key(key: Column) -> Column:
    """account_id, config_id, origin and filename of an upload key of exactly five parts; null otherwise."""
    parts = F.split(key, "/", -1)
    origin = F.element_at(parts, 4)
    fields = F.struct(
        F.element_at(parts, 2).alias("account_id"), F.element_at(parts, 3).alias("config_id"),
        F.when(origin.isin(*ORIGINS), origin).otherwise("UNKNOWN").alias("origin"), F.element_at(parts, 5).alias("filename"),
    )
    return F.when(F.size(parts) == 5, fields)


def transaction_key(bucket: Column, key: Column) -> Column:
    return F.sha2(F.concat_ws(":", bucket, key), 256)


def extension(filename: Column) -> Column:
    """Text after the last dot, in lower case; empty without a dot."""
    return F.lower(F.when(filename.contains("."), F.substring_index(filename, ".", -1)).otherwise(""))


def extension_allowed(filename: Column, allowed: Column) -> Column:
    """Whether a list (separated by commas, semicolons or spaces; dots and case do not matter) has the extension; an empty one has all."""
    items = F.filter(F.transform(F.split(F.lower(F.coalesce(allowed, F.lit(""))), r"[,;\s]+"), lambda x: F.ltrim(x, F.lit("."))), lambda x: x != "")
    return (F.size(items) == 0) | F.array_contains(items, extension(filename))


def admission(deposits: DataFrame, configs: DataFrame) -> DataFrame:
    """decision and reason for each deposit (key): the first check that fails is the reason.

    configs: config_id, account_id, is_active, filter_extensions. Joined by key, since its size is not known; Spark may split a config with many deposits.
    """
    rows = deposits.withColumn("p", parsed_key(F.col("key")))
    rows = rows.select("*", "p.*").drop("p")
    known = configs.select(F.col("config_id"), F.col("account_id").alias("owner"), "is_active", "filter_extensions", F.lit(True).alias("known"))
    rows = rows.join(known.hint("merge"), "config_id", "left")
    reason = (
        F.when(F.col("filename").isNull(), "invalid_key")
        .when(F.col("known").isNull(), "unknown_config")
        .when(F.col("owner") != F.col("account_id"), "account_mismatch")
        .when(~F.col("is_active"), "inactive_config")
        .when(~extension_allowed(F.col("filename"), F.col("filter_extensions")), "extension_refused")
        .otherwise("")
    )
    return rows.withColumn("reason", reason).withColumn("decision", F.when(F.col("reason") == "", "ACCEPTED").otherwise("REJECTED")).drop("owner", "known", "is_active", "filter_extensions")


def idempotent(deposits: DataFrame, existing: DataFrame, order: str) -> DataFrame:
    """Deposits whose key is new, the first of each by `order`; rows without a key all pass."""
    keyed = deposits.filter("coalesce(transaction_key, '') <> ''").join(existing.select("transaction_key").distinct(), "transaction_key", "left_anti")
    first = keyed.groupBy("transaction_key").agg(F.min_by(F.struct(*deposits.columns), order).alias("row")).select("row.*")
    return first.unionByName(deposits.filter("coalesce(transaction_key, '') = ''"))


def registry_upsert(registry: DataFrame, news: DataFrame, key: tuple[str, ...], attributes: tuple[str, ...], at: str = "last_seen_at", tie: str = "event_id") -> DataFrame:
    """One row for each key: of every attribute the newest value that is not empty; the latest sighting."""
    both = registry.unionByName(news, allowMissingColumns=True)
    order = F.struct(at, tie)
    newest = [F.max_by(a, F.when(F.coalesce(F.col(a), F.lit("")) != "", order)).alias(a) for a in attributes]
    return both.groupBy(*key).agg(*newest, F.max(at).alias(at))


def purge(registry: DataFrame, now: Column, minutes: int) -> DataFrame:
    """What stays after rows last seen before the window are gone, and how many went, on each row."""
    old = F.col("last_seen_at") < now - F.make_dt_interval(mins=F.lit(minutes))
    gone = registry.agg(F.count_if(old).alias("purged"))
    return registry.filter(~old).crossJoin(F.broadcast(gone))


def sender_allowed(sender: Column, whitelist: Column) -> Column:
    """Whether the address (inside <...>, or all of it) fits a pattern with * and ? of the list; an empty list admits all."""
    inside = F.regexp_extract(F.coalesce(sender, F.lit("")), "<([^>]+)>", 1)
    address = F.lower(F.when(inside != "", inside).otherwise(F.trim(F.coalesce(sender, F.lit("")))))
    patterns = F.filter(F.transform(F.split(F.lower(F.coalesce(whitelist, F.lit(""))), "[,\n]"), lambda p: F.trim(p)), lambda p: p != "")

    def fits(p: Column) -> Column:
        literal = F.regexp_replace(p, r"([\\.^$|()\[\]{}+])", r"\\$1")
        return F.regexp_like(address, F.concat(F.lit("(?s)^"), F.replace(F.replace(literal, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$")))

    return (F.trim(F.coalesce(whitelist, F.lit(""))) == "") | F.exists(patterns, fits)


def mail_part_kept(mode: Column, is_body: Column, filename: Column, allowed: Column) -> Column:
    """Body parts unless only attachments are wanted, attachments of allowed extensions unless only bodies are."""
    how = F.when(mode.isin("body", "attachments"), mode).otherwise("all")
    return F.when(is_body, how != "attachments").otherwise((how != "body") & extension_allowed(filename, allowed))


def mail_headers(headers: Column) -> Column:
    """The kept headers: addresses in lower case, at most five, as a JSON list; subjects cut at 200 characters, others at 300."""
    address = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+"
    kept = F.map_filter(headers, lambda k, v: F.lower(k).isin(*HEADERS) & v.isNotNull())
    lists = ("from", "to", "cc", "reply-to")
    return F.transform_values(
        kept,
        lambda k, v: F.when(F.lower(k).isin(*lists), F.to_json(F.slice(F.regexp_extract_all(F.lower(v), F.lit(address), F.lit(0)), 1, 5))).otherwise(F.when(F.lower(k) == "subject", F.substring(v, 1, 200)).otherwise(F.substring(v, 1, 300))),
    )


#: File extensions by kind of conversion, and documents that are zip files inside.
IMAGES = "png jpg jpeg tif tiff bmp gif webp".split()
OFFICE = "doc docx xls xlsx ppt pptx odt ods odp rtf".split()
TEXT = "txt csv md log json xml html htm".split()
ZIP_DOCUMENTS = "docx xlsx pptx docm xlsm pptm odt ods odp odg epub jar apk".split()


def content_kind(content: Column, filename: Column) -> Column:
    """pdf, image, office, text or unknown, by the first bytes, then the extension."""
    head, ext = F.hex(F.substring(content, 1, 8)), extension(filename)
    image = head.startswith("89504E470D0A1A0A") | head.startswith("FFD8") | head.startswith("4949") | head.startswith("4D4D") | head.startswith("424D") | head.startswith("47494638")
    return F.when(head.startswith("25504446") | (ext == "pdf"), "pdf").when(image | ext.isin(*IMAGES), "image").when(ext.isin(*OFFICE), "office").when(ext.isin(*TEXT), "text").otherwise("unknown")


def container_category(content: Column, filename: Column) -> Column:
    """ZIP, EML or FILE; office documents are files although they are zip inside."""
    head, ext = F.hex(F.substring(content, 1, 8)), extension(filename)
    start = F.lower(F.decode(F.substring(content, 1, 2048), "ISO-8859-1"))
    mail = (ext == "eml") | start.contains("from:") | start.contains("received:") | start.contains("subject:") | start.contains("message-id:")
    return F.when(ext.isin(*ZIP_DOCUMENTS), "FILE").when(head.startswith("504B"), "ZIP").when(mail, "EML").otherwise("FILE")


def limited_members(members: DataFrame, *, most_depth: int = 5, most_members: int = 10_000, most_bytes: int = 500_000_000) -> DataFrame:
    """Container members (container, position, depth, size) within the limits: with too many members none, and a running size that stops."""
    whole = Window.partitionBy("container")
    running = Window.partitionBy("container").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    rows = members.withColumn("members", F.count("*").over(whole)).withColumn("bytes", F.sum("size").over(running))
    state = F.when(F.col("members") > most_members, "too_many_members").when(F.col("depth") > most_depth, "too_deep").when(F.col("bytes") > most_bytes, "too_large").otherwise("ok")
    return rows.withColumn("state", state).drop("members", "bytes")


def member_documents(members: DataFrame) -> DataFrame:
    """Documents of a container's members: root (replaced, if it has children), numbered children, and refused ones with a reason.

    members: root, position, ok, reason. With one good file and nothing refused, the root stays as it is.
    """
    per = members.groupBy("root").agg(F.count_if("ok").alias("good"), F.count_if(~F.col("ok")).alias("bad"))
    alone = (F.col("good") == 1) & (F.col("bad") == 0)
    roots = per.select(F.col("root").alias("document_id"), F.lit(None).cast("string").alias("parent_id"), F.when(alone | (F.col("good") + F.col("bad") == 0), "CREATED").otherwise("DEPRECATED").alias("status"), F.lit("").alias("reason"), F.when(alone, 0).otherwise(F.col("bad")).cast("long").alias("n_discarded"))
    number = F.row_number().over(Window.partitionBy("root").orderBy("position"))
    children = members.join(per.filter(~alone), "root").withColumn("n", number)
    rows = children.select(
        F.format_string("%s_%05d", "root", "n").alias("document_id"), F.col("root").alias("parent_id"), F.when(F.col("ok"), "CREATED").otherwise("DISCARDED").alias("status"),
        F.when(F.col("ok"), "").otherwise(F.col("reason")).alias("reason"), F.lit(0).cast("long").alias("n_discarded"),
    )
    return roots.unionByName(rows)


def reference_rows(raw: DataFrame) -> DataFrame:
    """Account rows from CSV text: BOM removed, flags read, base64 JSON decoded (or kept raw), five address columns as a map of those filled."""
    clean = F.regexp_replace("account_id", "^﻿", "")
    decoded = F.try_to_binary("settings", F.lit("base64")).cast("string")
    address = F.map_filter(F.create_map(*[x for i in range(1, 6) for x in (F.lit(f"address{i}"), F.col(f"address{i}"))]), lambda k, v: F.coalesce(F.trim(v), F.lit("")) != "")
    return raw.select(clean.alias("account_id"), "account_name", F.lower(F.trim("active")).isin(*TRUE_WORDS).alias("active"), F.coalesce(decoded, "settings").alias("settings"), address.alias("address"))


FIELD = "struct<field_name:string,use_ia:string,regexp:string,anchors:string,direction:string,max_distance:string,zone:string,page_zone:string,bcr_type:string,black_words:string,default_value:string,required:string,is_separator:string,field_type:string,field_description:string>"


def is_true(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin(*TRUE_WORDS), F.lit(False))


def doctype_fields(doctypes: DataFrame, json: str = "json_content") -> DataFrame:
    """One row for each field of each readable type definition, in order; unreadable definitions have none."""
    parsed = F.from_json(json, f"struct<document_type:string,fields:array<{FIELD}>>")
    out = doctypes.withColumn("__d", parsed).select("*", F.posexplode("__d.fields").alias("field_no", "f"))
    flags = ("use_ia", "required", "is_separator")
    fields = [is_true(F.col(f"f.{c}")).alias(c) if c in flags else F.col(f"f.{c}").alias(c) for c in (x.split(":")[0] for x in FIELD[7:-1].split(","))]
    return out.select(*doctypes.columns, F.col("__d.document_type").alias("document_type"), "field_no", *fields).drop(json)


def expected_entries(configs: DataFrame, json: str = "expected") -> DataFrame:
    """(config_id, doctype_id, required) from lists of objects or, in the old form, of strings; the first of equal ids wins."""
    rows = configs.select("config_id", F.posexplode(F.from_json(json, "array<string>")).alias("n", "item"))
    id_ = F.coalesce(F.get_json_object("item", "$.doctype_id"), F.when(~F.col("item").startswith("{"), F.col("item")))
    required = F.coalesce(F.get_json_object("item", "$.required"), F.lit("true"))
    rows = rows.select("config_id", "n", F.trim(id_).alias("doctype_id"), is_true(required).alias("required")).filter("doctype_id <> ''")
    return rows.groupBy("config_id", "doctype_id").agg(F.min_by("required", "n").alias("required"), F.min("n").alias("n"))


def new_transactions(existing: DataFrame, deposits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Transactions and root documents after deposits: missing ones are made, and an empty key is filled but never overwritten."""
    found = existing.join(deposits.select("transaction_id", F.col("transaction_key").alias("new_key")), "transaction_id", "left")
    kept = found.withColumn("transaction_key", F.coalesce(F.nullif("transaction_key", F.lit("")), "new_key")).drop("new_key")
    fresh = deposits.join(existing.select("transaction_id"), "transaction_id", "left_anti")
    made = fresh.select("transaction_id", "transaction_key", F.lit("WORKING").alias("status"), F.lit("NEWDOC").alias("process"), "origin", F.lit(1).alias("nb_docs"))
    roots = fresh.select(F.col("transaction_id").alias("document_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("CREATED").alias("status"))
    return kept.unionByName(made, allowMissingColumns=True), roots


def intake_summary(outcomes: DataFrame) -> DataFrame:
    """Listed, ingested, skipped, moved and failed deposits by source, and in total (source null)."""
    state = F.col("outcome")
    count = lambda name: F.count_if(state == name).alias(name)
    return outcomes.rollup("source").agg(F.count("*").alias("listed"), count("ingested"), count("skipped"), F.count_if("moved").alias("moved"), count("error"))
