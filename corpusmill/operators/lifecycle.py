"""Serving and lifecycle tables: skills, proposals, sessions, signals, jobs, conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import MASTER, path_regex, terms
from .delta import latest

# Fixed value: characters that are kept of a job's error.
MOST_ERROR = 1000


def find_skills(queries: DataFrame, skills: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, name, tier, score, rank): the product's first master, then its other skills by shared words and confidence.

    ``queries``: query_id, product_id, query[, file, context]; ``skills``: product_id, name, tier, confidence, body[, description, contexts, files,
    file_patterns]. A skill with path patterns (``files``, or regular expressions in ``file_patterns``) needs one that
    fits the query's file, one with contexts the query's context, where the query has one other than general. Masters pass no
    such filter. Words have three characters or more; a score is the shared part of the query's and its context's words and a fifth of
    the confidence, or the confidence alone where there are no words. Ties go by name.

    Queries meet the skills that share a word with them; of the others only the best of each kind of filter can come in.
    """
    optional = lambda df, c, kind: (F.col(c) if c in df.columns else F.lit(None)).cast(kind)
    words = lambda c: terms(c, 3)
    context = F.coalesce(F.nullif(optional(queries, "context", "string"), F.lit("")), F.lit("general"))
    q = queries.select("query_id", "product_id", words(F.concat_ws(" ", "query", context)).alias("q"), optional(queries, "file", "string").alias("file"), context.alias("context"))
    some = lambda c: F.coalesce(optional(skills, c, "array<string>"), F.array().cast("array<string>")).alias(c)
    s = skills.select("product_id", "name", "tier", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), some("contexts"), some("files"), some("file_patterns"), words(F.concat_ws(" ", "name", optional(skills, "description", "string"), F.concat_ws(" ", some("contexts")), "body")).alias("t"))
    plain = s.where(F.col("tier") != MASTER)
    met = q.select("query_id", "product_id", F.explode("q").alias("w")).join(plain.select("product_id", "name", F.explode("t").alias("w")), ["product_id", "w"]).groupBy("query_id", "product_id", "name").agg(F.count("*").alias("n"))
    alike = Window.partitionBy("product_id", "contexts", "files", "file_patterns").orderBy(F.desc("confidence"), "name")
    rest = plain.withColumn("_n", F.row_number().over(alike)).where(F.col("_n") <= k).select("product_id", "name")
    rest = q.select("query_id", "product_id").join(rest, "product_id").select("query_id", "product_id", "name", F.lit(0).cast("long").alias("n"))
    x = met.unionByName(rest).groupBy("query_id", "product_id", "name").agg(F.max("n").alias("n"))
    x = x.join(plain.drop("t"), ["product_id", "name"]).join(q.drop("product_id"), "query_id")
    path = F.exists("files", lambda g: F.regexp(F.col("file"), path_regex(g))) | F.exists("file_patterns", lambda p: F.regexp(F.col("file"), p))
    fits = (F.col("file").isNull() | (F.size("files") + F.size("file_patterns") == 0) | path) & ((F.size("contexts") == 0) | (F.col("context") == "general") | F.array_contains("contexts", F.col("context")))
    score = F.when(F.size("q") == 0, F.col("confidence")).otherwise(F.col("n") / F.size("q") + 0.2 * F.col("confidence"))
    x = x.where(fits).select("query_id", "name", "tier", F.round(score, 6).alias("score"), F.lit(1).alias("_late"))
    slug = F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.lower("product_id"), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit("")), F.lit("product"))
    own = Window.partitionBy("product_id").orderBy(F.col("name") != F.concat(slug, F.lit("-skill")), F.desc("confidence"), "name")
    first = s.where(F.col("tier") == MASTER).withColumn("_n", F.row_number().over(own)).where("_n = 1").select("product_id", "name", "tier", "confidence", "t")
    shared = F.size(F.array_intersect("q", "t"))
    score = F.when(F.size("q") == 0, F.col("confidence")).otherwise(shared / F.size("q") + 0.2 * F.col("confidence"))
    first = q.join(first, "product_id").select("query_id", "name", "tier", F.round(score, 6).alias("score"), F.lit(0).alias("_late"))
    w = Window.partitionBy("query_id").orderBy("_late", F.desc("score"), "name")
    return first.unionByName(x).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "name", "tier", "score", "rank")


def by_tier(skills: DataFrame) -> DataFrame:
    return skills.groupBy("product_id", "tier").agg(F.array_sort(F.collect_list("name")).alias("names"))


def newest(rows: DataFrame, by: list[str], n: int, at: str = "at", tie: str = "id") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc(at), F.desc(tie))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def quality_panel(results: DataFrame, signals: DataFrame, n: int = 20) -> DataFrame:
    """(skill, results, failures, signals, latest, regenerate) over the latest ``n`` of each."""
    r = newest(results, ["skill"], n).groupBy("skill").agg(F.count("*").alias("results"), F.count_if(F.col("verdict") == "failed").alias("failures"), F.max_by("verdict", F.struct("at", "id")).alias("latest"))
    s = newest(signals, ["skill"], n).groupBy("skill").agg(F.count("*").alias("signals"))
    x = r.join(s, "skill", "full").fillna(0, ["results", "failures", "signals"])
    return x.withColumn("regenerate", (F.col("failures") > 0) | (F.col("signals") > 0))


def run_status(results: DataFrame) -> DataFrame:
    """(run_id, status, passed, total) from an append-only log: the last verdict of each skill counts."""
    last = latest(results, ["run_id", "skill"], F.desc("at"), F.desc("id"))
    got = last.groupBy("run_id").agg(F.count_if(F.col("verdict") != "failed").alias("passed"), F.count("*").alias("total"))
    status = F.when(F.col("passed") == 0, "failed").when(F.col("passed") < F.col("total"), "partial").otherwise("passed")
    return got.select("run_id", status.alias("status"), "passed", "total")


def transitions(events: DataFrame) -> DataFrame:
    """(id, status, approver, finished_at): the last event wins, the last named approver stays."""
    seq = F.struct("at", "event_id")
    return events.groupBy("id").agg(F.max_by("status", seq).alias("status"), F.max_by("approver", F.when(F.col("approver").isNotNull(), seq)).alias("approver"), F.max(F.when(F.col("status").isin("approved", "rejected"), F.col("at"))).alias("finished_at"))


def visible(proposals: DataFrame, membership: DataFrame, status: str | None = None) -> DataFrame:
    x = proposals.join(membership.select("user_id", "product_id").distinct(), "product_id")
    return x if status is None else x.where(F.col("status") == status)


def visible_counts(proposals: DataFrame, membership: DataFrame, status: str | None = None) -> DataFrame:
    """(user_id, n): how many of ``visible`` a user sees, from a count a product, so that no proposal meets each member."""
    own = proposals if status is None else proposals.where(F.col("status") == status)
    n = own.groupBy("product_id").agg(F.count("*").alias("n"))
    return membership.select("user_id", "product_id").distinct().join(n, "product_id").groupBy("user_id").agg(F.sum("n").alias("n"))


def product_stage(products: DataFrame, sources: DataFrame, skills: DataFrame, proposals: DataFrame, sessions: DataFrame) -> DataFrame:
    """(product_id, stage, live): review > skill > council > ingesting > none."""
    s = sources.groupBy("product_id").agg(F.lit(True).alias("has"), F.bool_or((F.col("status") != "syncing") & F.col("last_sync").isNotNull() & (F.col("resources") > 0)).alias("embedded"))
    flag = lambda df, name: df.select("product_id").distinct().withColumn(name, F.lit(True))
    live = sessions.where(~F.col("status").isin("completed", "failed", "stopped"))
    x = products.select("product_id").join(s, "product_id", "left").join(flag(skills, "skill"), "product_id", "left").join(flag(proposals.where("status = 'pending'"), "pending"), "product_id", "left").join(flag(live, "live"), "product_id", "left")
    stage = F.when(F.col("pending"), "review").when(F.col("skill"), "skill").when(F.col("embedded"), "council").when(F.col("has"), "ingesting").otherwise("none")
    return x.select("product_id", stage.alias("stage"), F.coalesce("live", F.lit(False)).alias("live"))


def queue_step(jobs: DataFrame, claim: int, at: Column, max_attempts: int = 3) -> DataFrame:
    """Jobs after one turn at ``at``: done ones leave, failed ones (error) retry or end, and of all products' pending
    ones with attempts left the ``claim`` that were touched longest ago run, one attempt more.

    The claimed are found by a global top-n, so no window gathers the queue.
    """
    open_ = (F.col("status") == "pending") & (F.col("attempts") < max_attempts)
    next_ = jobs.where(open_).orderBy("updated_at", "id").limit(claim).select("id", F.lit(True).alias("_mine"))
    x = jobs.where("status <> 'done'").join(F.broadcast(next_), "id", "left")  # ``claim`` rows at most
    status = F.when(F.col("_mine"), "running").when(F.col("status") == "error", F.when(F.col("attempts") < max_attempts, "pending").otherwise("failed")).otherwise(F.col("status"))
    moved = F.col("_mine").isNotNull() | (F.col("status") == "error")
    kept = [F.substring(c, 1, MOST_ERROR).alias(c) if c == "last_error" else c for c in jobs.columns if c not in ("status", "attempts", "updated_at")]
    return x.select(*kept, status.alias("status"), (F.col("attempts") + F.col("_mine").isNotNull().cast("int")).alias("attempts"), F.when(moved, at).otherwise(F.col("updated_at")).alias("updated_at"))


def enqueue(jobs: DataFrame, new: DataFrame, at: Column) -> DataFrame:
    """Jobs with the ``new`` ones in, by id; one without an id gets ``product_id:source_key:uri``. A job that was there starts anew as pending,
    without attempts and error, with all that the new one brings but its ``created_at``. Of several new ones with one id the last (by seq) counts.

    ``new``: seq and columns of ``jobs``; columns that it lacks stay as they were, or null. Nothing new leaves the jobs as they are.
    """
    job_id = F.concat_ws(":", *[c for c in ("product_id", "source_key", "uri") if c in new.columns])
    new = new.withColumn("id", F.coalesce(F.nullif("id", F.lit("")), job_id) if "id" in new.columns else job_id)
    new = latest(new, ["id"], F.col("seq").desc_nulls_last())
    fresh = {"status": F.lit("pending"), "attempts": F.lit(0), "last_error": F.lit(None), "updated_at": at}
    side = new.select(F.col("id"), F.lit(True).alias("_new"), *[F.col(c).alias(f"_{c}") for c in new.columns if c in jobs.columns and c not in ("id", *fresh)])

    def value(c: str) -> Column:
        kind = jobs.schema[c].dataType
        if c in fresh:
            return F.when(F.col("_new"), fresh[c].cast(kind)).otherwise(F.col(c)).alias(c)
        if c == "created_at":
            return F.when(F.col("_new"), F.coalesce(c, at.cast(kind))).otherwise(F.col(c)).alias(c)
        return F.when(F.col("_new"), F.col(f"_{c}").cast(kind)).otherwise(F.col(c)).alias(c) if f"_{c}" in side.columns else F.col(c)

    return jobs.join(side, "id", "full").select(*[F.col("id") if c == "id" else value(c) for c in jobs.columns])


def reset_running(jobs: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """Jobs with the running ones pending again (their worker is gone), and how many they were of each product (product_id, n)."""
    was = F.col("status") == "running"
    out = jobs.withColumns({"status": F.when(was, "pending").otherwise(F.col("status")), "updated_at": F.when(was, at).otherwise(F.col("updated_at"))})
    return out, jobs.where(was).groupBy("product_id").agg(F.count("*").alias("n"))


def queue_counts(jobs: DataFrame, statuses: tuple[str, ...] = ("pending", "running", "failed"), products: DataFrame | None = None) -> DataFrame:
    """(product_id, one column a status): jobs by status; ``products`` without a job have zeros."""
    n = jobs.groupBy("product_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in statuses])
    return n if products is None else products.select("product_id").distinct().join(n, "product_id", "left").fillna(0, list(statuses))


def fresh_jobs(jobs: DataFrame, manifest: DataFrame) -> DataFrame:
    return jobs.join(manifest.select("product_id", "uri", "content_hash"), ["product_id", "uri", "content_hash"], "left_semi")


def token_costs(calls: DataFrame) -> DataFrame:
    return calls.groupBy("agent", "model").agg(F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"))


def conversation_tail(messages: DataFrame, n: int) -> DataFrame:
    """(conv_id, place, role, text): the last ``n`` messages of each conversation, in order."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("role"))
    x = messages.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n)
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("_n")))
    return x.select("conv_id", place.alias("place"), "role", "text")


def skill_signals(signals: DataFrame, skill: str, most: int = 6, cut: int = 240) -> DataFrame:
    """Product-wide signals and those of the skill, the newest ``most`` of each product."""
    own = signals.where(F.col("skill").isNull() | (F.col("skill") == skill))
    return newest(own, ["product_id"], most).withColumn("text", F.substring("text", 1, cut))


def signals_for(skills: DataFrame, signals: DataFrame, most: int = 6, ids: int = 8, cut: int = 240) -> DataFrame:
    """(product_id, skill, prompt, signal_ids) of ``skills`` (product_id, skill): their own and the product-wide signals (product_id, id, skill, source, text,
    at), newest first; the first ``most`` as lines ``- source: text`` on one line of ``cut`` characters each, the ids of the first ``ids``.

    A signal without skill (null or empty) is product-wide. Without signals the prompt is ``(none)``. Only the newest of each product and of each
    skill meet the skills, so no skill brings more rows than it can show.
    """
    k = max(most, ids)
    s = signals.withColumn("skill", F.nullif("skill", F.lit("")))
    wide, own = newest(s.where("skill is null"), ["product_id"], k).drop("skill", "rank"), newest(s.where("skill is not null"), ["product_id", "skill"], k).drop("rank")
    asked = skills.select("product_id", "skill").distinct()
    x = asked.join(wide, "product_id").unionByName(asked.join(own, ["product_id", "skill"]))
    x = newest(x, ["product_id", "skill"], k)
    line = F.concat(F.lit("- "), F.coalesce("source", F.lit("signal")), F.lit(": "), F.substring(F.replace(F.trim(F.coalesce("text", F.lit("")), F.lit(" \n\r\t")), F.lit("\n"), F.lit(" ")), 1, cut))
    told = lambda c, n: F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= n, F.struct("rank", c.alias("v"))))), lambda r: r["v"])
    x = x.groupBy("product_id", "skill").agg(F.array_join(told(line, most), "\n").alias("prompt"), told(F.col("id"), ids).alias("signal_ids"))
    kind = x.schema["signal_ids"].dataType
    return asked.join(x, ["product_id", "skill"], "left").select("product_id", "skill", F.coalesce("prompt", F.lit("(none)")).alias("prompt"), F.coalesce("signal_ids", F.array().cast(kind)).alias("signal_ids"))


def product_list(products: DataFrame, membership: DataFrame, skills: DataFrame, sessions: DataFrame) -> DataFrame:
    n = skills.groupBy("product_id").agg(F.count("*").alias("skills"))
    last = sessions.where("status = 'completed'").groupBy("product_id").agg(F.max("at").alias("last_session"))
    return products.join(membership, "product_id", "left_semi").join(n, "product_id", "left").join(last, "product_id", "left").fillna(0, ["skills"])


def dashboard(sessions: DataFrame, skills: DataFrame, proposals: DataFrame) -> DataFrame:
    count = lambda df, name: df.agg(F.count("*").alias("n")).withColumn("what", F.lit(name))
    return count(sessions, "sessions").unionByName(count(skills, "skills")).unionByName(count(proposals.where("status = 'pending'"), "pending")).select("what", "n")


def product_dashboard(products: DataFrame, sessions: DataFrame, skills: DataFrame, proposals: DataFrame) -> DataFrame:
    """(product_id, council, skills, pending): sessions, skills and pending proposals of each product, zero where there are none."""
    own = products.select("product_id").distinct()
    for df, name in ((sessions, "council"), (skills, "skills"), (proposals.where("status = 'pending'"), "pending")):
        own = own.join(df.groupBy("product_id").agg(F.count("*").alias(name)), "product_id", "left")
    return own.fillna(0, ["council", "skills", "pending"])


def product_recent(sessions: DataFrame, proposals: DataFrame, most: int = 10) -> DataFrame:
    """(product_id, what, rank, id, title, status, at, confidence): the newest sessions, as activity, and the newest pending proposals of each product."""
    a = newest(sessions, ["product_id"], most, "started_at").select("product_id", F.lit("activity").alias("what"), "rank", "id", F.concat(F.lit("Council: "), "topic").alias("title"), "status", F.col("started_at").alias("at"), F.lit(None).cast("double").alias("confidence"))
    p = newest(proposals.where("status = 'pending'"), ["product_id"], most, "created_at").select("product_id", F.lit("pending").alias("what"), "rank", "id", F.col("name").alias("title"), "status", F.col("created_at").alias("at"), F.col("confidence").cast("double").alias("confidence"))
    return a.unionByName(p)


def membership_map(members: DataFrame) -> DataFrame:
    return members.groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("product_id", "role")))).alias("roles"))


def corrections(proposals: DataFrame, kind: str) -> DataFrame:
    """approved with a critique, or rejected."""
    return proposals.where((F.col("status") == "approved") & F.col("critique").isNotNull() if kind == "corrections" else F.col("status") == "rejected")


def skill_history(asked: DataFrame, sessions: DataFrame) -> DataFrame:
    """(skill_id, rank, session columns): the sessions of the product of each asked skill (skill_id, product_id), newest first by started_at, then id."""
    ranked = sessions.withColumn("rank", F.row_number().over(Window.partitionBy("product_id").orderBy(F.desc("started_at"), F.desc("id"))))
    return asked.select("skill_id", "product_id").distinct().join(ranked, "product_id")


def skill_reviews(asked: DataFrame, proposals: DataFrame) -> DataFrame:
    """(skill_id, kind, id, created_at, critique): the corrections (approved, with a critique) and rejections of the product of each asked skill."""
    both = [corrections(proposals.withColumn("critique", F.nullif("critique", F.lit(""))), k).select("product_id", F.lit(k).alias("kind"), "id", "created_at", "critique") for k in ("corrections", "rejections")]
    return asked.select("skill_id", "product_id").distinct().join(both[0].unionByName(both[1]), "product_id").drop("product_id")


def reported_signals(outcomes: DataFrame, source: str = "outcome") -> DataFrame:
    """(id, product_id, skill, source, text, at, succeeded): one signal for each reported outcome (id, product_id, skill, succeeded, notes, at), its notes or what came of it."""
    said = F.coalesce(F.nullif(F.trim(F.col("notes")), F.lit("")), F.when(F.col("succeeded"), "Skill succeeded.").otherwise("Skill failed."))
    return outcomes.select("id", "product_id", "skill", F.lit(source).alias("source"), said.alias("text"), "at", F.coalesce("succeeded", F.lit(False)).alias("succeeded"))


def outcome_signals(results: DataFrame) -> DataFrame:
    """One signal row for each failing result."""
    return results.where("verdict = 'failed'").select("skill", F.lit("eval").alias("source"), "at", F.concat(F.lit("failed run "), "run_id").alias("text"))


def delete_rows(rows: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """What is left, and (key, deleted) for each id that was asked."""
    have = rows.select(key).distinct().withColumn("deleted", F.lit(True))
    return rows.join(ids, key, "left_anti"), ids.select(key).distinct().join(have, key, "left").select(key, F.coalesce("deleted", F.lit(False)).alias("deleted"))


def upsert_rows(rows: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a dimension with the ``new`` ones in the place of those with their keys; of several new ones the last (by seq) counts."""
    new = latest(new, keys, F.col("seq").desc_nulls_last()).drop("seq")
    return rows.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def product_sources(sources: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, rank, source columns): what each asked (query_id, product_id, wanted) finds among its product's sources: the one whose id or else name
    is ``wanted``, or all where that is null; newest first by created_at, then id. Equal names are all found."""
    x = sources.join(asked.select("query_id", "product_id", "wanted"), "product_id")
    x = x.where(F.col("wanted").isNull() | (F.col("wanted") == F.col("id")) | (F.col("wanted") == F.col("name")))
    w = Window.partitionBy("query_id").orderBy(F.desc("created_at"), F.desc("id"))
    return x.withColumn("rank", F.row_number().over(w)).drop("wanted")


def delete_sources(sources: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sources without the asked ones (product_id, wanted: an id or a name), and (product_id, wanted, deleted) for each that was asked."""
    asked = asked.select("product_id", "wanted").distinct()
    named = sources.select("product_id", F.col("id").alias("_id"), F.explode(F.array_distinct(F.array("id", "name"))).alias("wanted"))
    hit = named.join(asked, ["product_id", "wanted"])
    gone = hit.select("product_id", F.col("_id").alias("id")).distinct()
    went = hit.select("product_id", "wanted").distinct().withColumn("deleted", F.lit(True))
    return sources.join(gone, ["product_id", "id"], "left_anti"), asked.join(went, ["product_id", "wanted"], "left").select("product_id", "wanted", F.coalesce("deleted", F.lit(False)).alias("deleted"))


def role_of(members: DataFrame, user: Column) -> DataFrame:
    return members.where(F.col("user_id") == user).select("product_id", "role")
