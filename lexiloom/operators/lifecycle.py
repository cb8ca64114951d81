"""Tables of chunks, conversations, users, teams and models, and what changes them.

A change takes a table and gives the new one; writing it is Spark's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHUNKS = "chunk_id string, tenant_id string, kb_id string, source string, section string, chunk_index int, text string, embedding array<float>, metadata map<string,string>, created_at timestamp"
# What may be uploaded, roles and states of members, and enabled models.
UPLOADS = {"txt": "text/plain", "md": "text/markdown", "html": "text/html", "htm": "text/html", "csv": "text/csv", "json": "application/json", "pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation"}
LONGEST_NAME = 255
ENABLED = "1"


def create_index(spark: SparkSession, name: str, schema: str = CHUNKS) -> None:
    """A table of chunks, parted by tenant, unless it is there."""
    columns = ", ".join(f"`{n}` {t}" for n, t in (x.strip().split(" ", 1) for x in schema.split(", ")))
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet PARTITIONED BY (tenant_id)")


def index_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def drop_index(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def clear_index(spark: SparkSession, name: str) -> None:
    """All rows gone, the table stays."""
    spark.sql(f"TRUNCATE TABLE {name}")


def checked_inserts(rows: DataFrame, dims: int) -> tuple[DataFrame, DataFrame]:
    """Chunks to be inserted: those that may, with an id each (of their content
    where none is given), and (chunk_id, error) of the rest."""
    own = F.coalesce("chunk_id", F.sha2(F.concat_ws("\u0001", "tenant_id", "source", F.col("chunk_index").cast("string"), "text"), 256))
    error = F.when(F.col("text").isNull(), "no text").when(F.col("tenant_id").isNull(), "no tenant").when(F.size("embedding") != dims, F.concat(F.lit("embedding of "), F.size("embedding").cast("string")))
    marked = rows.withColumns({"chunk_id": own, "_error": error})
    return marked.where("_error is null").drop("_error"), marked.where("_error is not null").select("chunk_id", F.col("_error").alias("error"))


def valid_upload(name: Column, media_type: Column) -> Column:
    """An array of what is wrong with an upload's name and type; empty if nothing is."""
    kinds = F.create_map(*[F.lit(x) for pair in UPLOADS.items() for x in pair])
    extension = F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1))
    known = F.try_element_at(kinds, extension)
    wrong = [F.when(F.coalesce(F.char_length(F.trim(name)), F.lit(0)) == 0, "no name").when(F.char_length(name) > LONGEST_NAME, "name too long"), F.when(known.isNull(), "unsupported format"), F.when(known.isNotNull() & media_type.isNotNull() & (media_type != known) & (media_type != "application/octet-stream"), "type does not match")]
    return F.array_compact(F.array(*wrong))


def is_conversation_id(value: Column) -> Column:
    return F.coalesce(value.rlike(r"\A[A-Za-z0-9_-]{1,64}\z"), F.lit(False))


def referenced(images: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Images (image) that chunks (image) still show, and those that none does."""
    shown = chunks.select("image").where("image is not null").distinct()
    return images.join(shown, "image", "left_semi"), images.join(shown, "image", "left_anti")


# ---- conversations (conv_id, user_id, title, share_token, updated_at) and messages (conv_id, turn, role, text)


def save_conversation(conversations: DataFrame, messages: DataFrame, new: DataFrame, new_messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New or changed conversations and all their messages in place of the old ones."""
    keys = new.select("conv_id")
    return conversations.join(keys, "conv_id", "left_anti").unionByName(new), messages.join(keys, "conv_id", "left_anti").unionByName(new_messages)


def delete_conversations(conversations: DataFrame, messages: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, user_id) pairs that exist go, with their messages; another user's stay."""
    own = conversations.join(gone, ["conv_id", "user_id"], "left_semi").select("conv_id")
    return conversations.join(own, "conv_id", "left_anti"), messages.join(own, "conv_id", "left_anti")


def duplicate_conversations(conversations: DataFrame, messages: DataFrame, wanted: DataFrame, suffix: str = " (副本)") -> tuple[DataFrame, DataFrame]:
    """Copies of (conv_id, user_id, new_id), of a title with a suffix and not shared, and of their messages."""
    copied = conversations.join(wanted, ["conv_id", "user_id"]).withColumns({"title": F.concat("title", F.lit(suffix)), "share_token": F.lit(None).cast("string")})
    rows = messages.join(copied.select("conv_id", "new_id"), "conv_id").drop("conv_id").withColumnRenamed("new_id", "conv_id")
    return conversations.unionByName(copied.drop("conv_id").withColumnRenamed("new_id", "conv_id")), messages.unionByName(rows)


def share_conversations(conversations: DataFrame, wanted: DataFrame, secret: str) -> DataFrame:
    """A token for each wanted (conv_id, user_id) that has none; others keep theirs."""
    token = F.left(F.sha2(F.concat_ws("\u0001", F.lit(secret), "conv_id", "user_id"), 256), F.lit(32))
    marked = conversations.join(wanted.withColumn("_w", F.lit(True)), ["conv_id", "user_id"], "left")
    return marked.withColumn("share_token", F.when(F.col("_w"), F.coalesce("share_token", token)).otherwise(F.col("share_token"))).drop("_w").select(*conversations.columns)


# ---- members (user_id, tenant_id, role, status, inviter_id)


def member_of(members: DataFrame, status: str = "active", role: str | None = None) -> DataFrame:
    kept = members.where(F.col("status") == status)
    return kept.where(F.col("role") == role) if role else kept


def register_users(users: DataFrame, tenants: DataFrame, members: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New users (user_id, username) whose name is free, the first of equal ones,
    each with a tenant of its own id and as its owner."""
    once = new.withColumn("_n", F.row_number().over(Window.partitionBy("username").orderBy("user_id"))).where("_n = 1").drop("_n")
    free = once.join(users.select("username"), "username", "left_anti").select("user_id", "username")
    tenant = free.select(F.col("user_id").alias("tenant_id"), F.concat("username", F.lit("'s team")).alias("name"))
    owner = free.select("user_id", F.col("user_id").alias("tenant_id"), F.lit("owner").alias("role"), F.lit("active").alias("status"), F.lit(None).cast("string").alias("inviter_id"))
    return users.unionByName(free), tenants.unionByName(tenant), members.unionByName(owner)


def change_members(members: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (tenant_id, user_id, by, action, role): an invited user accepts or
    rejects; an owner sets a role or removes a member, not themselves. What
    isn't allowed changes nothing."""
    owners = members.where("status = 'active' and role = 'owner'").select("tenant_id", F.col("user_id").alias("by"), F.lit(True).alias("_owner"))
    asked = requests.join(owners, ["tenant_id", "by"], "left").select("tenant_id", "user_id", "by", "action", F.col("role").alias("_role"), "_owner").dropDuplicates(["tenant_id", "user_id"])
    joined = members.join(asked, ["tenant_id", "user_id"], "left")
    own, owner = F.col("by") == F.col("user_id"), F.coalesce("_owner", F.lit(False)) & (F.col("by") != F.col("user_id"))
    pending = F.col("status") == "pending"
    gone = ((F.col("action") == "reject") & own & pending) | ((F.col("action") == "remove") & owner)
    kept = joined.where(~F.coalesce(gone, F.lit(False)))
    status = F.when((F.col("action") == "accept") & own & pending, "active").otherwise(F.col("status"))
    role = F.when((F.col("action") == "role") & owner & F.col("_role").isin("owner", "normal"), F.col("_role")).otherwise(F.col("role"))
    return kept.withColumns({"status": status, "role": role}).select(*members.columns)


def primary_tenant(members: DataFrame) -> DataFrame:
    """(user_id, tenant_id): where a user is an active owner, else any active one, the least of equals."""
    order = Window.partitionBy("user_id").orderBy(F.when(F.col("role") == "owner", 0).otherwise(1), "tenant_id")
    return members.where("status = 'active'").withColumn("_n", F.row_number().over(order)).where("_n = 1").select("user_id", "tenant_id")


def pending_invitations(members: DataFrame, tenants: DataFrame, users: DataFrame) -> DataFrame:
    """(user_id, tenant_id, tenant_name, inviter_name or null) of who is invited."""
    inviters = users.select(F.col("user_id").alias("inviter_id"), F.col("username").alias("inviter_name"))
    named = members.where("status = 'pending'").join(tenants.select("tenant_id", F.col("name").alias("tenant_name")), "tenant_id")
    return named.join(inviters, "inviter_id", "left").select("user_id", "tenant_id", "tenant_name", "inviter_name")


# ---- models (tenant_id, model, kind, status, used_tokens) and defaults (tenant_id, chat, embedding, rerank, ...)


def default_models(defaults: DataFrame, models: DataFrame, kinds: list[str]) -> DataFrame:
    """(tenant_id, kind, model) of each tenant's defaults that are enabled."""
    told = defaults.unpivot(["tenant_id"], kinds, "kind", "model").where("model is not null")
    return told.join(models.where(F.col("status") == ENABLED).select("tenant_id", "kind", "model").distinct(), ["tenant_id", "kind", "model"], "left_semi")


def count_tokens(models: DataFrame, usage: DataFrame) -> DataFrame:
    """Adds (tenant_id, model, tokens) to the models' counters."""
    n = usage.groupBy("tenant_id", "model").agg(F.sum("tokens").alias("_t"))
    return models.join(n, ["tenant_id", "model"], "left").withColumn("used_tokens", F.col("used_tokens") + F.coalesce("_t", F.lit(0))).select(*models.columns)


def seed(rows: DataFrame, given: DataFrame, key: str) -> DataFrame:
    """``rows`` and those of ``given`` whose key is absent, each once: again adds nothing."""
    new = given.dropDuplicates([key]).join(rows.select(key), key, "left_anti")
    return rows.unionByName(new)


def queue_upload(documents: DataFrame, tenant: str, kb: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, name, size) uploaded to a knowledge base -> pending rows with the
    object's key, and a high-priority task message each."""
    rows = documents.select("doc_id", "name", "size", F.lit(tenant).alias("tenant_id"), F.lit(kb).alias("kb_id"), F.concat_ws("/", F.lit(tenant), F.lit(kb), "doc_id", "name").alias("object_key"), F.lit("pending").alias("status"))
    return rows, rows.select(F.concat(F.lit("task-"), "doc_id").alias("task_id"), F.col("object_key").alias("file_path"), F.col("name").alias("source"), "tenant_id", "kb_id", F.lit("high").alias("priority"))


# ---- records and reports


def log_lines(events: DataFrame, kept: list[str]) -> DataFrame:
    """(ts, level, logger, message, ...) -> a JSON line each, with those of the extra columns that are kept."""
    extra = [c for c in kept if c in events.columns]
    return events.select(F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), "level", "logger", "message", *extra)).alias("value"))


def report_lines(results: DataFrame, title: str) -> DataFrame:
    """A Markdown report of a small table of results: (line, text), numbers with
    four digits; rows in the order of their first column."""
    shown = [F.coalesce(F.format_string("%.4f", F.col(f.name)) if f.dataType.typeName() in ("double", "float") else F.col(f.name).cast("string"), F.lit("-")) for f in results.schema]
    order = Window.orderBy(results.columns[0])
    rows = results.select((F.row_number().over(order) + 3).alias("line"), F.concat(F.lit("| "), F.concat_ws(" | ", *shown), F.lit(" |")).alias("text"))
    head = [f"# {title}", "| " + " | ".join(results.columns) + " |", "| " + " | ".join(["---"] * len(results.columns)) + " |"]
    return results.sparkSession.createDataFrame([(i + 1, x) for i, x in enumerate(head)], "line int, text string").unionByName(rows)


def read_reports(spark: SparkSession, folder: str) -> DataFrame:
    """(name, modified, report) of a folder's ``report*.json``, newest first; one that isn't JSON is left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "report*.json").load(folder)
    text = F.col("content").cast("string")
    named = files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("modificationTime").alias("modified"), F.try_parse_json(text).alias("report"))
    return named.where("report is not null").orderBy(F.desc("modified"), "name")


def is_report_name(name: Column) -> Column:
    """A report's plain file name, that leads nowhere else."""
    return F.coalesce(name.rlike(r"\Areport[\w.-]*\.json\z") & ~F.contains(name, F.lit("..")), F.lit(False))
