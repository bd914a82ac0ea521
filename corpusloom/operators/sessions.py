"""Sessions: their history, the pool of their papers, modes, entry states, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Modes, how they enter the agent, their budgets of searches, reads and papers, what
# they cite, whether they search beforehand, the prompt, and whether they may compute.
MODES = {
    "chat": ("direct", 0, 0, 0, "optional", False, "chat", False), "survey": ("quick", 3, 6, 3, "key_claims", True, "survey", False),
    "deep": ("full", 5, 15, 8, "every_claim", True, "deep", False), "read": ("quick", 0, 3, 1, "internal", False, "read", False),
    "compute": ("flexible", 2, 3, 0, "optional", False, "compute", True), "auto": ("adaptive", 4, 8, 3, "key_claims", True, "default", False),
}
MODE_FIELDS = ("path", "searches", "reads", "papers", "cites", "searches_before", "prompt", "computes")


def mode(name: Column) -> Column:
    """Struct of key and MODE_FIELDS; unknown or missing names are auto."""
    key = F.when(name.isin(*MODES), name).otherwise("auto")
    values = F.create_map(*(x for k, fields in MODES.items() for x in (F.lit(k), F.struct(*(F.lit(v).alias(f) for f, v in zip(MODE_FIELDS, fields, strict=True))))))
    found = F.element_at(values, key)
    return F.struct(key.alias("key"), *(found[c].alias(c) for c in MODE_FIELDS))


def entry_state(path: Column, intent: Column, has_pool: Column, is_followup: Column) -> Column:
    chat = intent == "chat"
    adaptive = F.when(is_followup & has_pool & ~chat, "deep_read").when(chat, "respond").otherwise("retrieve")
    return (
        F.when(path == "direct", "respond").when(path == "quick", "quick_read").when(path == "full", "retrieve")
        .when(path == "flexible", F.when(chat & ~has_pool, "respond").otherwise("retrieve")).otherwise(adaptive)
    )


def filled(*columns: str) -> Column:
    """The first of the columns that is neither null nor empty."""
    return F.coalesce(*(F.nullif(F.col(c).cast("string"), F.lit("")) for c in columns))


def pool_record(results: DataFrame) -> DataFrame:
    """Search results of any source in one form: source, title, journal, year, preview."""
    there = lambda *cs: filled(*(c for c in cs if c in results.columns))
    return results.select(
        "source", there("title").alias("title"), there("journal_name", "venue").alias("journal"), there("year", "_s2_year").try_cast("int").alias("year"),
        F.substring(F.coalesce(there("content", "abstract", "summary"), F.lit("")), 1, 500).alias("preview"),
    )


def merge_pool(pool: DataFrame, found: DataFrame, keys: tuple[str, ...] = ("session_id", "source")) -> DataFrame:
    """The pool with what was found: known papers keep what they have and get a missing title
    or year, new ones are added, the first of them by `seq`."""
    first = found.where(F.length("source") > 0).groupBy(*keys).agg(F.min_by(F.struct("title", "year", "preview"), "seq").alias("f"), F.min_by(F.nullif("title", F.lit("")), F.when(F.length("title") > 0, F.col("seq"))).alias("t"), F.min_by("year", F.when(F.col("year").isNotNull(), F.col("seq"))).alias("y"))
    joined = pool.withColumn("_known", F.lit(True)).join(first, list(keys), "full_outer")
    known = F.coalesce("_known", F.lit(False))
    return joined.select(
        *keys,
        F.coalesce(F.nullif(pool.title, F.lit("")), "t").alias("title"),
        F.coalesce(pool.year, F.col("y")).alias("year"),
        F.when(known, pool.preview).otherwise(F.col("f.preview")).alias("preview"),
        F.when(known, pool.is_read).otherwise(F.lit(False)).alias("is_read"),
        F.when(known, pool.has_fulltext).otherwise(F.lit(True)).alias("has_fulltext"),
    )


def mark(pool: DataFrame, outcomes: DataFrame, keys: tuple[str, ...] = ("session_id", "source")) -> DataFrame:
    """Papers read, or found to have no text (which counts as read)."""
    return pool.join(outcomes.select(*keys, F.col("ok").alias("_ok")), list(keys), "left").select(
        *keys, "title", "year", "preview", (F.col("is_read") | F.col("_ok").isNotNull()).alias("is_read"), F.coalesce("_ok", "has_fulltext").alias("has_fulltext")
    )


def read_ok(chars: Column, error: Column, text: Column) -> Column:
    """A read that gave 100 characters or more, no error and no sign of failure."""
    return (F.coalesce(chars, F.lit(0)) >= 100) & F.coalesce(F.length(error) == 0, F.lit(True)) & ~F.coalesce(text.rlike("(?i)not found|no full text|failed to"), F.lit(False))


def acquired(rows: DataFrame, least: int = 300, most: int = 2_000) -> DataFrame:
    """Which text of a paper counts: (tier, extracted, content_raw, has_file) to content,
    tier and status; a file of a second-tier paper lifts it to the first."""
    good = F.col("has_file") & (F.length("extracted") > least)
    raw = F.coalesce("content_raw", F.lit(""))
    first = F.col("tier") == 1
    status = F.when(good, "extracted").when(first & ~F.col("has_file"), "fallback_no_file").when(first & (raw != ""), "fallback").when(first, "failed").otherwise("abstract")
    content = F.when(good, F.col("extracted")).when(first, raw).otherwise(F.substring(raw, 1, most))
    return rows.select("doc_id", content.alias("content"), F.when(good, 1).otherwise(F.col("tier")).alias("tier"), status.alias("status"))


def compressed(messages: DataFrame, most_tokens: int = 6_000, long: int = 500) -> DataFrame:
    """In conversations over the token limit the first long system message becomes its first
    line and a snippet."""
    by = Window.partitionBy("conv_id")
    is_long = (F.col("role") == "system") & (F.length("text") > long)
    rows = messages.withColumn("_tokens", F.floor(F.sum(F.length("text")).over(by) / 4)).withColumn("_first", F.min(F.when(is_long, F.col("turn"))).over(by))
    short = F.concat(F.lit("[压缩] "), F.split_part("text", F.lit("\n"), F.lit(1)), F.lit("\n  摘要: "), F.replace(F.substring("text", 1, 300), F.lit("\n"), F.lit(" ")), F.lit("..."))
    return rows.select("conv_id", "turn", "role", F.when((F.col("_tokens") >= most_tokens) & (F.col("turn") == F.col("_first")), short).otherwise(F.col("text")).alias("text"))


def validated(sources: DataFrame, files: DataFrame, by: str = "conv_id") -> DataFrame:
    """Per `by`, sources with a file (validated) and without (supplementary), each once."""
    known = files.select("source").distinct().withColumn("_f", F.lit(True))
    flags = sources.select(by, "source").distinct().join(known, "source", "left")
    return flags.select(by, "source", F.when(F.col("_f"), "validated").otherwise("supplementary").alias("kind"))


def accumulated(parts: DataFrame, keys: tuple[str, ...], order: str, text: str) -> DataFrame:
    """Pieces of a text joined in order, for each key."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda s: s[text]), "")
    return parts.groupBy(*keys).agg(joined.alias(text), F.count("*").alias("n_parts"))


def filing_plan(rows: DataFrame, taken: DataFrame) -> DataFrame:
    """Moves of files to the folders they belong in: action, from, to; a name that is taken
    there gets _DUP. rows: name, folder, right_folder; taken: name, folder."""
    there = taken.select(F.col("folder").alias("right_folder"), "name").distinct().withColumn("_t", F.lit(True))
    wrong = rows.where("folder <> right_folder").join(there, ["right_folder", "name"], "left")
    to = F.when(F.col("_t"), F.concat(F.regexp_replace("name", r"\.pdf$", ""), F.lit("_DUP.pdf"))).otherwise(F.col("name"))
    return wrong.select("name", F.concat_ws("/", "folder", "name").alias("source_path"), F.concat(F.col("right_folder"), F.lit("/"), to).alias("target_path"), F.when(F.col("_t"), "conflict").otherwise("move").alias("action"))


def neighbours(edges: DataFrame, papers: DataFrame, of: str = "src", to: str = "dst", n: int = 10) -> DataFrame:
    """For each paper the n of its citations or references that are cited most."""
    facts = papers.select(F.col("doc_id").alias(to), "citations")
    ranked = edges.join(facts, to).withColumn("place", F.row_number().over(Window.partitionBy(of).orderBy(F.col("citations").desc(), to)))
    return ranked.where(F.col("place") <= n)


def session_states(operations: DataFrame) -> DataFrame:
    """Sessions after all operations on them (sid, seq, verb, role, text): sid, title,
    n_messages, recent (place by creation, the latest first).

    create gives a title; append adds a message, makes the session if need be (then the title
    is the first 50 characters of a user's message, else empty), and a session's first user
    message gives the title, cut at 40 characters; rename takes up to 60 characters, if any;
    delete ends the session, and what comes later starts anew. Each session is one sum of its
    operations: the last one that sets a title counts."""
    by, along = Window.partitionBy("sid"), Window.partitionBy("sid").orderBy("seq")
    alive = operations.withColumn("_gone", F.max(F.when(F.col("verb") == "delete", F.col("seq"))).over(by)).where("_gone is null or seq > _gone")
    text, own = F.coalesce("text", F.lit("")), (F.col("verb") == "append") & (F.col("role") == "user")
    rows = alive.withColumn("_first", F.row_number().over(along) == 1).withColumn("_users", F.sum(own.cast("int")).over(along)).withColumn("_there", F.max(F.col("verb").isin("create", "append").cast("int")).over(along) == 1)
    title = (
        F.when(F.col("verb") == "create", text)
        .when(own & (F.col("_users") == 1), F.when(F.length(text) > 40, F.concat(F.substring(text, 1, 40), F.lit("......"))).otherwise(text))
        .when((F.col("verb") == "append") & F.col("_first"), F.when(own, F.substring(text, 1, 50)).otherwise(F.lit("")))
        .when((F.col("verb") == "rename") & F.col("_there") & (F.length(F.trim(text)) > 0), F.substring(F.trim(text), 1, 60))
    )
    there = rows.withColumn("_title", title).where("_there")
    out = there.groupBy("sid").agg(F.max_by("_title", F.when(F.col("_title").isNotNull(), F.col("seq"))).alias("title"), F.count_if(F.col("verb") == "append").alias("n_messages"), F.min("seq").alias("created"))
    return out


def tasks_by_session(tasks: DataFrame, now: Column, keep: int = 60) -> DataFrame:
    """sid, n, running, tasks (id:done:error, in order of ids) of tasks (sid, task_id, at, done,
    error) that run or ended no more than `keep` seconds ago."""
    fresh = tasks.where(~F.col("done") | (F.unix_micros(now) - F.unix_micros(F.col("at")) <= keep * 1_000_000))
    line = F.concat_ws(":", F.col("task_id").cast("string"), F.col("done").cast("string"), F.col("error").cast("string"))
    return fresh.groupBy("sid").agg(F.count("*").alias("n"), F.count_if(~F.col("done")).alias("running"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("task_id", line.alias("l")))), lambda t: t["l"]), ",").alias("tasks"))


def replayed(parts: DataFrame, offsets: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """key, rest, upto: of a stream's pieces what a reader that has `seen` characters still gets,
    and how far it is then."""
    whole = accumulated(parts, (key,), order, text).join(offsets, key)
    return whole.select(key, F.when(F.col("seen") < F.length(text), F.substring(F.col(text), F.col("seen") + 1, F.length(text))).otherwise("").alias("rest"), F.greatest("seen", F.length(text)).alias("upto"))


def failure_streaks(events: DataFrame, by: str, order: str, failed: Column) -> DataFrame:
    """by, longest, current: runs of failures in a row, the longest and the one still going on."""
    along = Window.partitionBy(by).orderBy(order)
    rows = events.select(by, order, failed.cast("int").alias("_f")).withColumn("_run", F.sum(1 - F.col("_f")).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = rows.groupBy(by, "_run").agg(F.sum("_f").alias("_n"))
    return runs.groupBy(by).agg(F.max("_n").alias("longest"), F.max_by("_n", "_run").alias("current"))


# Tools that an agent may call in a state.
STATE_TOOLS = {
    "retrieve": ("search_papers", "search_arxiv", "search_semantic_scholar", "get_citations", "get_references", "search_perovskite_database"),
    "read": ("read_paper", "read_arxiv_paper", "extract_data", "compare_papers"),
}


def allowed(tool: Column, state: Column) -> Column:
    """Whether a tool may be called in a state; states without a list allow none."""
    return F.coalesce(*(F.when(state == s, tool.isin(*tools)) for s, tools in STATE_TOOLS.items()), F.lit(False))


def journal_by_prefix(rows: DataFrame, keys: DataFrame, name: str, default: int = 7) -> DataFrame:
    """rows with journal and journal_rank of the longest key (key, journal, journal_rank) that
    the name begins with, followed by an underscore; else null and the default. A key has as
    many parts as it has; names are looked up by their first parts, not key by key."""
    parts = F.split(name, "_")
    cuts = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "_"))
    tried = rows.select(name).distinct().where(F.contains(F.col(name), F.lit("_"))).select(name, F.explode(cuts).alias("key"))
    best = tried.join(keys, "key").groupBy(name).agg(F.max_by(F.struct("journal", "journal_rank"), F.length("key")).alias("_"))
    return rows.join(best, name, "left").select(*rows.columns, F.col("_.journal").alias("journal"), F.coalesce("_.journal_rank", F.lit(default)).alias("journal_rank"))
