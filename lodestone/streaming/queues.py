"""State transitions of processing queues: claims with leases, retries with backoff, releases, resets, tokens.

Each transition is a projection of the state table (or of one join with it), so it runs the same over a
batch table and inside foreachBatch, where streaming.events.apply_stream runs it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import backoff
from lodestone.operators.filters import alive
from lodestone.registry import query
from lodestone.views import JOB_PAGE, NOW, table, view

LEASE = 900
MAX_ATTEMPTS = 10


def due(status: str = "extract_status", now: int = NOW) -> Column:
    """Alive, waiting or with a lease that ran out."""
    return F.col("deleted_at").isNull() & F.col(status).isin("pending", "processing") & (F.col("next_retry_at") <= now)


def claimed(state: DataFrame, limit: int, status: str = "extract_status", now: int = NOW) -> DataFrame:
    """state with its first due rows taken: processing, leased until now + LEASE. The batch size is the feature."""
    picked = state.where(due(status, now)).orderBy("id").limit(limit).select("id", F.lit(True).alias("_taken"))
    joined = state.join(picked, "id", "left")
    taken = F.coalesce("_taken", F.lit(False))
    return joined.withColumns({status: F.when(taken, "processing").otherwise(F.col(status)), "next_retry_at": F.when(taken, now + LEASE).otherwise(F.col("next_retry_at"))}).drop("_taken")


_DUE = f"deleted_at IS NULL AND {{s}}_status IN ('pending', 'processing') AND next_retry_at <= {NOW}"


@query(f", t AS (SELECT id FROM articles WHERE {_DUE.format(s='extract')} ORDER BY id LIMIT 40) SELECT id, CASE WHEN id IN (FROM t) THEN 'processing' ELSE extract_status END AS extract_status, CASE WHEN id IN (FROM t) THEN {NOW + LEASE} ELSE next_retry_at END AS next_retry_at FROM articles")
def claim_lease(spark, sf):
    return claimed(view(spark, sf, "articles"), 40).select("id", "extract_status", "next_retry_at")


@query(f"SELECT id FROM articles WHERE {_DUE.format(s='index')} AND extract_status = 'done' ORDER BY id LIMIT 40")
def claim_index(spark, sf):
    """The index phase takes what extraction has finished."""
    return view(spark, sf, "articles").where(due("index_status") & (F.col("extract_status") == "done")).orderBy("id").limit(40).select("id")


@query(f"SELECT id FROM articles WHERE {_DUE.format(s='compile')} AND index_status = 'done' ORDER BY index_done_chunks, id LIMIT 40")
def claim_compile(spark, sf):
    return view(spark, sf, "articles").where(due("compile_status") & (F.col("index_status") == "done")).orderBy("index_done_chunks", "id").limit(40).select("id")


@query(f", t AS (SELECT p.job_id, p.page_num FROM job_pages p JOIN jobs j ON j.id = p.job_id AND j.deleted_at IS NULL AND j.status IN ('pending', 'processing') WHERE p.status = 'pending' AND p.next_retry_at <= {NOW} ORDER BY 1, 2 LIMIT 100) SELECT j.id, CASE WHEN j.status = 'pending' AND j.id IN (SELECT job_id FROM t) THEN 'processing' ELSE j.status END AS status FROM jobs j")
def page_claim(spark, sf):
    """Jobs after a claim of pages: those with a claimed page are processing."""
    jobs = view(spark, sf, "jobs")
    live = alive(jobs).where(F.col("status").isin("pending", "processing")).select(F.col("id").alias("job_id"))
    pages = view(spark, sf, "job_pages").where(f"status = 'pending' AND next_retry_at <= {NOW}").join(live, "job_id", "left_semi").orderBy("job_id", "page_num").limit(100)
    hit = pages.select(F.col("job_id").alias("id"), F.lit(True).alias("hit")).distinct()
    return jobs.join(hit, "id", "left").select("id", F.when((F.col("status") == "pending") & F.coalesce("hit", F.lit(False)), "processing").otherwise(F.col("status")).alias("status"))


@query(f"SELECT id, CASE WHEN extract_status = 'processing' THEN 'pending' ELSE extract_status END AS extract_status, CASE WHEN extract_status = 'processing' THEN {NOW} ELSE next_retry_at END AS next_retry_at FROM articles")
def release_claims(spark, sf):
    held = F.col("extract_status") == "processing"
    return view(spark, sf, "articles").select("id", F.when(held, "pending").otherwise(F.col("extract_status")).alias("extract_status"), F.when(held, NOW).otherwise(F.col("next_retry_at")).alias("next_retry_at"))


def failed(state: DataFrame, hit: Column, status: str, now: int = NOW) -> DataFrame:
    """state after the rows in hit failed once more: tried again later, or failed for good after MAX_ATTEMPTS."""
    tries = F.col("attempts") + 1
    gone = tries >= MAX_ATTEMPTS
    return state.withColumns({status: F.when(hit & gone, "failed").when(hit, "pending").otherwise(F.col(status)), "next_retry_at": F.when(hit & ~gone, now + 60 * backoff(tries)).otherwise(F.col("next_retry_at")), "attempts": F.when(hit, tries).otherwise(F.col("attempts"))})


_FAIL = "CASE WHEN {s} = 'processing' AND attempts + 1 >= 10 THEN 'failed' WHEN {s} = 'processing' THEN 'pending' ELSE {s} END AS {s}, CASE WHEN {s} = 'processing' AND attempts + 1 < 10 THEN " + str(NOW) + " + 60 * CAST(least(pow(2, attempts), 30) AS BIGINT) ELSE next_retry_at END AS next_retry_at, CASE WHEN {s} = 'processing' THEN attempts + 1 ELSE attempts END AS attempts"


@query(f"SELECT id, {_FAIL.format(s='extract_status')} FROM articles")
def mark_error(spark, sf):
    return failed(view(spark, sf, "articles"), F.col("extract_status") == "processing", "extract_status").select("id", "extract_status", "next_retry_at", "attempts")


@query(f"SELECT job_id, page_num, {_FAIL.format(s='status')} FROM job_pages")
def page_fail(spark, sf):
    return failed(view(spark, sf, "job_pages"), F.col("status") == "processing", "status").select("job_id", "page_num", "status", "next_retry_at", "attempts")


@query("SELECT a.id, CASE WHEN index_status = 'done' AND coalesce(n, 0) < index_done_chunks THEN 'pending' ELSE index_status END AS index_status, CASE WHEN index_status = 'done' AND coalesce(n, 0) < index_done_chunks THEN 0 ELSE index_done_chunks END AS index_done_chunks FROM articles a LEFT JOIN (SELECT article_id AS id, count(*) AS n FROM points GROUP BY 1) p USING (id)")
def verify_after_write(spark, sf):
    """Articles with fewer points than they claim start over."""
    counts = view(spark, sf, "points").groupBy(F.col("article_id").alias("id")).agg(F.count("*").alias("n"))
    short = (F.col("index_status") == "done") & (F.coalesce("n", F.lit(0)) < F.col("index_done_chunks"))
    return view(spark, sf, "articles").join(counts, "id", "left").select("id", F.when(short, "pending").otherwise(F.col("index_status")).alias("index_status"), F.when(short, 0).otherwise(F.col("index_done_chunks")).alias("index_done_chunks"))


@query("SELECT user_id, count(*) AS requeued FROM articles a WHERE index_status = 'done' AND index_done_chunks > 0 AND NOT EXISTS (SELECT 1 FROM points p WHERE p.article_id = a.id) GROUP BY 1")
def reconcile(spark, sf):
    """Articles to index again for each owner: those done whose points are all missing."""
    points = view(spark, sf, "points").select(F.col("article_id").alias("id"))
    return view(spark, sf, "articles").where("index_status = 'done' AND index_done_chunks > 0").join(points, "id", "left_anti").groupBy("user_id").agg(F.count("*").alias("requeued"))


_RESET = "CASE WHEN user_id = 2 AND id % 3 = 0 AND deleted_at IS NULL THEN {v} ELSE {c} END AS {c}"


@query("SELECT id, " + ", ".join(_RESET.format(c=c, v=v) for c, v in (("index_status", "'pending'"), ("compile_status", "'pending'"), ("attempts", "0"), ("index_done_chunks", "0"))) + " FROM articles")
def reset_index(spark, sf):
    hit = (F.col("user_id") == 2) & (F.col("id") % 3 == 0) & F.col("deleted_at").isNull()
    return view(spark, sf, "articles").select("id", *[F.when(hit, v).otherwise(F.col(c)).alias(c) for c, v in (("index_status", "pending"), ("compile_status", "pending"), ("attempts", 0), ("index_done_chunks", 0))])


@query("SELECT id, " + ", ".join(_RESET.format(c=c, v=v) for c, v in (("extract_status", "'pending'"), ("attempts", "0"))) + " FROM articles")
def reset_extract(spark, sf):
    hit = (F.col("user_id") == 2) & (F.col("id") % 3 == 0) & F.col("deleted_at").isNull()
    return view(spark, sf, "articles").select("id", *[F.when(hit, v).otherwise(F.col(c)).alias(c) for c, v in (("extract_status", "pending"), ("attempts", 0))])


@query("SELECT a.id, coalesce(n, index_done_chunks) AS index_done_chunks, CASE WHEN n >= 9 THEN 'done' ELSE index_status END AS index_status FROM articles a LEFT JOIN (SELECT article_id AS id, max(chunk_index) AS n FROM points GROUP BY 1) p USING (id)")
def mark_progress(spark, sf):
    """Progress reported by id; complete ones are done."""
    news = view(spark, sf, "points").groupBy(F.col("article_id").alias("id")).agg(F.max("chunk_index").alias("n"))
    return view(spark, sf, "articles").join(news, "id", "left").select("id", F.coalesce("n", "index_done_chunks").alias("index_done_chunks"), F.when(F.col("n") >= 9, "done").otherwise(F.col("index_status")).alias("index_status"))


@query("SELECT p.job_id, p.page_num, CASE WHEN p.status = 'pending' AND j.id IS NOT NULL THEN 'cancelled' ELSE p.status END AS status FROM job_pages p LEFT JOIN (SELECT id FROM jobs WHERE status IN ('pending', 'processing') AND id % 5 = 1) j ON j.id = p.job_id")
def scan_cancel(spark, sf):
    """Pages after every fifth job was cancelled, where it could be."""
    jobs = view(spark, sf, "jobs").where("status IN ('pending', 'processing') AND id % 5 = 1").select(F.col("id").alias("job_id"), F.lit(True).alias("hit"))
    return view(spark, sf, "job_pages").join(jobs, "job_id", "left").select("job_id", "page_num", F.when((F.col("status") == "pending") & F.col("hit").isNotNull(), "cancelled").otherwise(F.col("status")).alias("status"))


@query("SELECT job_id, page_num, CASE WHEN status <> 'processing' AND page_num = 1 THEN 'pending' ELSE status END AS status, CASE WHEN status <> 'processing' AND page_num = 1 THEN 0 ELSE attempts END AS attempts FROM job_pages")
def scan_page_reset(spark, sf):
    hit = (F.col("status") != "processing") & (F.col("page_num") == 1)
    return view(spark, sf, "job_pages").select("job_id", "page_num", F.when(hit, "pending").otherwise(F.col("status")).alias("status"), F.when(hit, 0).otherwise(F.col("attempts")).alias("attempts"))


@query(f"SELECT job_id, page_num, CASE WHEN status = 'processing' THEN 'pending' ELSE status END AS status, CASE WHEN status = 'processing' THEN {NOW} ELSE next_retry_at END AS next_retry_at FROM job_pages")
def scan_release(spark, sf):
    held = F.col("status") == "processing"
    return view(spark, sf, "job_pages").select("job_id", "page_num", F.when(held, "pending").otherwise(F.col("status")).alias("status"), F.when(held, NOW).otherwise(F.col("next_retry_at")).alias("next_retry_at"))


def pages_saved(state: DataFrame, results: DataFrame) -> DataFrame:
    """Job pages (job_id, page_num, status, attempts, error) after recognition: words, text and mean confidence are kept, the error and the attempts cleared.

    results (job_id, page_num, text, words: array of struct text, conf; status or null). One with a status is a person's edit and
    keeps it; blank words become none. A result whose page is not there or not being processed is an error.
    """
    keys = ["job_id", "page_num"]
    known = results.select(*keys, F.col("text").alias("_text"), F.filter("words", lambda w: F.btrim(w["text"]) != "").alias("_words"), F.col("status").alias("_status"), F.lit(True).alias("_saved"))
    both = state.join(known, keys, "full")
    lost = F.col("_saved") & (F.col("status").isNull() | (F.col("_status").isNull() & (F.col("status") != "processing")))
    saved = F.when(F.coalesce(lost, F.lit(False)), F.raise_error(F.concat(F.lit("no page to save: "), F.col("job_id").cast("string"), F.lit("/"), F.col("page_num").cast("string"))).cast("boolean")).otherwise(F.coalesce("_saved", F.lit(False)))
    rows = both.withColumn("_saved", saved)
    conf = F.try_divide(F.aggregate("_words", F.lit(0.0), lambda s, w: s + w["conf"]), F.size("_words"))
    return rows.select(
        *keys,
        F.when(F.col("_saved"), F.coalesce("_status", F.lit("ocr_done"))).otherwise(F.col("status")).alias("status"),
        F.when(F.col("_saved"), 0).otherwise(F.col("attempts")).alias("attempts"),
        F.when(~F.col("_saved"), F.col("error")).alias("error"),
        F.when(F.col("_saved"), F.col("_text")).alias("text"),
        F.when(F.col("_saved"), F.transform("_words", lambda w: w["text"])).alias("words"),
        F.when(F.col("_saved"), F.round(conf, 9)).alias("conf"),
    )


_OCR = "array(struct(concat(l_returnflag, l_linestatus) AS text, l_quantity AS conf), struct(' ' AS text, 1.0 AS conf), struct(concat('p', l_partkey) AS text, l_discount AS conf))"


@query("""SELECT job_id, page_num, CASE WHEN hit THEN 'ocr_done' WHEN edited THEN 'edited' ELSE status END AS status, CASE WHEN hit OR edited THEN 0 ELSE attempts END AS attempts, CASE WHEN NOT hit AND NOT edited AND attempts > 5 THEN 'timeout' END AS error,
 CASE WHEN hit OR edited THEN text END AS text, CASE WHEN hit OR edited THEN [a, b] END AS words, CASE WHEN hit OR edited THEN round((l_quantity + l_discount) / 2, 9) END AS conf
FROM (SELECT p.*, status = 'processing' AS hit, status = 'failed' AND l_partkey % 2 = 0 AS edited, concat(l_returnflag, ' ', l_partkey) AS text, concat(l_returnflag, l_linestatus) AS a, concat('p', l_partkey) AS b, l_quantity, l_discount
 FROM (SELECT *, row_number() OVER (PARTITION BY job_id, page_num ORDER BY l_partkey, l_suppkey, l_quantity) AS k FROM (SELECT l_orderkey AS job_id, l_linenumber AS page_num, """ + JOB_PAGE["status"].replace("AS STRING", "AS VARCHAR") + """ AS status, l_suppkey % 11 AS attempts, * FROM lineitem)) p WHERE k = 1)""")
def scan_page_save(spark, sf):
    """Pages of stored jobs after recognition of those being processed, and after edits of every other failed one; of repeated page numbers the first counts."""
    first = table(spark, sf, "lineitem").selectExpr("l_orderkey AS job_id", "l_linenumber AS page_num", f"struct(l_partkey, l_suppkey, l_quantity, l_discount, l_returnflag, l_linestatus, {JOB_PAGE['status']} AS status) AS x")
    pages = first.groupBy("job_id", "page_num").agg(F.min("x").alias("x")).select("job_id", "page_num", "x.*")
    attempts = F.col("l_suppkey") % 11
    state = pages.select("job_id", "page_num", "status", attempts.alias("attempts"), F.when(attempts > 5, "timeout").alias("error"))
    edited = F.expr("status = 'failed' AND l_partkey % 2 = 0")
    found = pages.where(F.expr("status = 'processing'") | edited)
    results = found.select("job_id", "page_num", F.concat("l_returnflag", F.lit(" "), "l_partkey").alias("text"), F.expr(_OCR).alias("words"), F.when(edited, "edited").alias("status"))
    return pages_saved(state, results)


@query(f"SELECT id, CASE WHEN status = 'done' AND deleted_at IS NULL THEN {NOW} END AS pushed_at, CASE WHEN status = 'done' AND deleted_at IS NULL THEN {NOW} + 86400 ELSE expires_at END AS expires_at FROM jobs")
def scan_mark_pushed(spark, sf):
    hit = (F.col("status") == "done") & F.col("deleted_at").isNull()
    return view(spark, sf, "jobs").select("id", F.when(hit, NOW).alias("pushed_at"), F.when(hit, NOW + 86400).otherwise(F.col("expires_at")).alias("expires_at"))


@query(f"SELECT token_hash, CASE WHEN revoked_at IS NOT NULL THEN 'revoked' WHEN expires_at <= {NOW} OR family_expires_at <= {NOW} THEN 'expired' WHEN rotated_at IS NOT NULL THEN 'reused' ELSE 'ok' END AS verdict, CASE WHEN revoked_at IS NULL AND expires_at > {NOW} AND family_expires_at > {NOW} AND rotated_at IS NULL THEN least({NOW} + 50000, family_expires_at) END AS new_expiry FROM tokens")
def token_rotate(spark, sf):
    """What a refresh gives for each token; the new one ends with its family at the latest."""
    expired = (F.col("expires_at") <= NOW) | (F.col("family_expires_at") <= NOW)
    verdict = F.when(F.col("revoked_at").isNotNull(), "revoked").when(expired, "expired").when(F.col("rotated_at").isNotNull(), "reused").otherwise("ok")
    rows = view(spark, sf, "tokens").select("token_hash", "family_expires_at", verdict.alias("verdict"))
    return rows.select("token_hash", "verdict", F.when(F.col("verdict") == "ok", F.least(F.lit(NOW + 50000), "family_expires_at")).alias("new_expiry"))


@query(f"SELECT token_hash, CASE WHEN revoked_at IS NULL AND family_id IN (SELECT family_id FROM tokens WHERE token_hash IN (3, 8, 9999999)) THEN {NOW} ELSE revoked_at END AS revoked_at FROM tokens")
def revoke_family(spark, sf):
    """All tokens of the named tokens' families are revoked, unless they were; unknown tokens name none."""
    tokens = view(spark, sf, "tokens")
    families = tokens.where(F.col("token_hash").isin(3, 8, 9999999)).select("family_id", F.lit(True).alias("hit")).distinct()
    return tokens.join(families, "family_id", "left").select("token_hash", F.when(F.col("revoked_at").isNull() & F.col("hit").isNotNull(), NOW).otherwise(F.col("revoked_at")).alias("revoked_at"))


def touched(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """conversations (conversation_id, user_id, scope, last_turn, title) after turns (conversation_id, user_id, turn, content, scope).

    An owner's turns only: the last one counts, the scope is set anew, and the title is the first message's head, but only where there is none.
    """
    news = turns.groupBy("conversation_id", "user_id").agg(F.max("turn").alias("_turn"), F.left(F.min_by("content", "turn"), F.lit(60)).alias("_title"), F.max_by("scope", "turn").alias("_scope"))
    joined = conversations.join(news, ["conversation_id", "user_id"], "left")
    title = F.when(F.col("title") == "", F.coalesce("_title", "title")).otherwise(F.col("title"))
    return joined.select("conversation_id", "user_id", F.coalesce("_scope", "scope").alias("scope"), F.greatest("last_turn", "_turn").alias("last_turn"), title.alias("title"))


@query("""SELECT c.conversation_id, c.user_id, CASE WHEN mine THEN n.scope ELSE 'all' END AS scope, CASE WHEN mine THEN n.last_turn ELSE 0 END AS last_turn, CASE WHEN c.conversation_id % 3 = 0 THEN 'kept' WHEN mine THEN n.title ELSE '' END AS title
FROM (SELECT DISTINCT conversation_id, user_id, user_id <> 4 AS mine FROM messages) c JOIN (SELECT conversation_id, max(turn) AS last_turn, left(min_by(content, turn), 60) AS title, 'cat ' || (max(turn) % 4) AS scope FROM messages GROUP BY 1) n USING (conversation_id)""")
def conversation_touch(spark, sf):
    """Stored conversations, every third with a title, after their messages; those of one owner come from another and change nothing."""
    rows = view(spark, sf, "messages")
    stored = rows.select("conversation_id", "user_id", F.lit("all").alias("scope"), F.lit(0).cast("long").alias("last_turn"), F.when(F.col("conversation_id") % 3 == 0, "kept").otherwise("").alias("title")).distinct()
    sent = rows.select("conversation_id", F.when(F.col("user_id") == 4, -1).otherwise(F.col("user_id")).alias("user_id"), "turn", "content", F.concat(F.lit("cat "), F.col("turn") % 4).alias("scope"))
    return touched(stored, sent)


@query("SELECT conversation_id, turn, role FROM messages UNION ALL SELECT conversation_id, max(turn) + k, CASE k WHEN 1 THEN 'user' ELSE 'assistant' END FROM messages, (VALUES (1), (2)) v(k) GROUP BY conversation_id, k")
def append_turn(spark, sf):
    """One user row and one assistant row more in each conversation."""
    rows = view(spark, sf, "messages").select("conversation_id", "turn", "role")
    last = rows.groupBy("conversation_id").agg(F.max("turn").alias("last"))
    both = last.select("conversation_id", "last", F.explode(F.array(F.lit(1), F.lit(2))).alias("k"))
    return rows.union(both.select("conversation_id", F.col("last") + F.col("k"), F.when(F.col("k") == 1, "user").otherwise("assistant")))


@query("SELECT event_id, user_id, n <= 3 AS allowed FROM (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts) RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS n FROM (SELECT event_id, user_id, date_trunc('second', ts) AS ts FROM events))")
def sliding_governor(spark, sf):
    """Whether an event is within three of its user in the trailing hour."""
    events = table(spark, sf, "events").withColumn("s", F.unix_timestamp("ts"))
    n = F.count("*").over(Window.partitionBy("user_id").orderBy("s").rangeBetween(-3600, 0))
    return events.select("event_id", "user_id", (n <= 3).alias("allowed"))


@query("SELECT worker_id, max(last_seen_at) AS last_seen_at FROM heartbeats GROUP BY 1")
def heartbeat_upsert(spark, sf):
    return view(spark, sf, "heartbeats").groupBy("worker_id").agg(F.max("last_seen_at").alias("last_seen_at"))
