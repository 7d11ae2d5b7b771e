"""Claims, consensus, summaries and checkpoints, over conversations, lineitem, documents, labels and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions.text import first_topic
from claimloom.operators import claims as c
from claimloom.operators import evaluation, lookup
from claimloom.sources.tables import table


def claim_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as claims: the role is the agent, the text the utterance."""
    k = F.col("turn") % 3
    kind = F.when(F.col("role") == "user", "person").when(F.col("role") == "assistant", "organization").otherwise("robot")
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("article_id"),
        F.col("turn").alias("pos"),
        F.col("role").alias("agent_name"),
        F.col("text").alias("agent_description"),
        kind.alias("agent_type"),
        F.when(k == 0, "direct").when(k == 1, "indirect").otherwise("Partial").alias("utterance_type"),
        F.col("text").alias("utterance_text"),
        F.concat("role", F.lit(": "), "text").alias("source_context"),
    )


def claim_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which claims are valid."""
    f = c.FIELDS
    return claim_table(spark, sf_dir).select("article_id", "pos", c.valid(F.col(f[0]), F.col(f[4]), F.col(f[2]), F.col(f[3]), F.col(f[1]), F.col(f[5])).alias("is_valid"))


def unique_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per agent of an article, as first described."""
    return c.unique_agents(claim_table(spark, sf_dir))


def claim_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct claims numbered within their article."""
    return c.ordinals(claim_table(spark, sf_dir)).select("article_id", F.md5(F.col("utterance_text").cast("binary")).alias("text_md5"), "agent_name", "first_pos", F.col("n").cast("bigint").alias("n"))


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines 1 to 3 as the findings of annotators A to C, one row per order and annotator."""
    rows = table(spark, sf_dir, "lineitem").filter(F.col("l_linenumber").between(1, 3))
    rows = rows.select(F.col("l_orderkey").alias("key"), F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), F.col("l_linenumber")).alias("annotator"), "l_returnflag", "l_linestatus")
    return c.per_annotator(rows, ["key"], ["l_returnflag", "l_linestatus"])


def consensus_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings that two of three annotators share, fields by majority, ties to the first annotator."""
    return c.consensus(annotations(spark, sf_dir), ["key"], ["l_returnflag", "l_linestatus"])


def consensus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by annotator and the share of findings that is retained."""
    rows = annotations(spark, sf_dir)
    s = c.statistics(rows, c.consensus(rows, ["key"], ["l_returnflag", "l_linestatus"]))
    return s.withColumn("average_per_llm", F.round("average_per_llm", 6)).withColumn("retention_rate", F.round("retention_rate", 6))


def chrono_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as positions held, the running ones first."""
    date = F.date_format("o_orderdate", "yyyy-MM-dd")
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("pos"), F.when(F.col("o_orderpriority") != "1-URGENT", date).alias("start_date"), F.when(F.col("o_orderstatus") != "O", date).alias("end_date"))
    return lookup.chronological(rows, "o_custkey").select("o_custkey", "pos", F.col("rank").cast("bigint").alias("rank"))


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), "source", "lang")
    rows = claim_table(spark, sf_dir)
    agents = c.unique_agents(rows).select("article_id", "agent_name", F.col("agent_type").alias("info"))
    return lookup.condensed(articles, rows.select("article_id", "pos", F.struct("agent_name", "utterance_text").alias("claim")), agents)


def summary_condensed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with their claims and agents nested, shown as counts and strings."""
    first = F.md5(F.get("claims", 0)["utterance_text"].cast("binary"))
    return _summary(spark, sf_dir).select("article_id", "source", F.size("claims").alias("n_claims"), first.alias("first_claim_md5"), F.array_join(F.map_keys("agents_info"), ",").alias("agents"), F.array_join(F.map_values("agents_info"), ",").alias("types"))


def summary_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the summary."""
    return lookup.totals(_summary(spark, sf_dir))


def checkpoint_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose checkpoint can be used, and those still to process."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"))
    marks = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("article_id"), F.lit("2026-01-01").alias("timestamp"), F.when(F.col("toxic") == 0, "success").otherwise("error").alias("status"), F.col("quality").alias("claims"), F.when(F.col("quality") == 1, F.col("quality")).alias("agents_info"))
    done = lookup.resumable(marks)
    return docs.join(done.select("article_id"), "article_id", "left_semi").withColumn("state", F.lit("done")).union(lookup.to_process(docs, done).withColumn("state", F.lit("todo")))


def history_last_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts per user, and the last one's type."""
    return lookup.last_attempts(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type")


TOPICS = {"src1": ("One", "Topic one"), "src5": ("Five", "Topic five"), "9": ("Nine", "Topic nine")}


def topic_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first topic whose key a source contains."""
    return table(spark, sf_dir, "documents").select("doc_id", first_topic(F.col("source"), TOPICS).alias("topic"), first_topic(F.col("source"), TOPICS, 1).alias("label"))


def topic_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims per article by source: mean and deviations."""
    articles = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), F.col("source").alias("topic"))
    s = evaluation.claims_per_article(claim_table(spark, sf_dir), articles)
    return s.withColumns({x: F.round(x, 6) for x in ("mean_claims", "sd_claims", "sd_pop_claims")})


def eval_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A length rule against the quality labels."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    s = evaluation.precision_recall(rows.select((F.col("n_chars") < 1000).alias("a"), (F.col("quality") == 0).alias("b")), "a", "b")
    return s.withColumns({x: F.round(x, 6) for x in ("precision", "recall", "f1")})


def claims_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agents found against the agents of a gold standard, by article and name."""
    rows = claim_table(spark, sf_dir)
    pairs = evaluation.matched_claims(rows.filter("pos % 2 = 0"), rows.filter("agent_type <> 'robot'"), ["article_id", "agent_name"])
    s = evaluation.precision_recall(pairs, "predicted", "actual")
    return s.withColumns({x: F.round(x, 6) for x in ("precision", "recall", "f1")})


_ANN = "SELECT l_orderkey AS key, ['A', 'B', 'C'][l_linenumber] AS annotator, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus FROM lineitem WHERE l_linenumber BETWEEN 1 AND 3 GROUP BY 1, 2"


def _vote_sql(f: str) -> str:
    return f"(SELECT key, {f} FROM (SELECT key, {f}, row_number() OVER (PARTITION BY key ORDER BY count(*) DESC, min(annotator)) AS r FROM ann GROUP BY key, {f}) WHERE r = 1)"


_CONS = f"SELECT g.key, g.annotators, a.l_returnflag, b.l_linestatus FROM (SELECT key, count(DISTINCT annotator) AS annotators FROM ann GROUP BY key HAVING count(DISTINCT annotator) >= 2) g JOIN {_vote_sql('l_returnflag')} a ON a.key = g.key JOIN {_vote_sql('l_linestatus')} b ON b.key = g.key"
_PRF = "round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1"
_KIND = "CASE role WHEN 'user' THEN 'person' WHEN 'assistant' THEN 'organization' ELSE 'robot' END"

QUERIES = {f.__name__: f for f in (claim_validate, unique_agents, claim_ordinal, consensus_vote, consensus_stats, chrono_sort, summary_condensed, summary_totals, checkpoint_resume, history_last_attempt, topic_first_match, topic_stats, eval_prf, claims_matched)}
ORACLES = {
    "claim_validate": r"SELECT conv_id AS article_id, turn AS pos, coalesce(regexp_replace(text, '\s', '', 'g') <> '' AND role <> '' AND role IN ('user', 'assistant') AND turn % 3 < 2, false) AS is_valid FROM conversations",
    "unique_agents": f"SELECT conv_id AS article_id, role AS agent_name, arg_min({_KIND}, turn) AS agent_type, arg_min(text, turn) AS agent_description FROM conversations WHERE role <> '' GROUP BY 1, 2",
    "claim_ordinal": "SELECT article_id, md5(text) AS text_md5, agent_name, first_pos, row_number() OVER (PARTITION BY article_id ORDER BY first_pos) AS n FROM (SELECT conv_id AS article_id, text, role AS agent_name, min(turn) AS first_pos FROM conversations GROUP BY 1, 2, 3)",
    "consensus_vote": f"WITH ann AS ({_ANN}) {_CONS}",
    "consensus_stats": f"WITH ann AS ({_ANN}), f AS (SELECT count(*) AS n FROM ({_CONS})) SELECT count(*) FILTER (annotator = 'A') AS \"llm_A_claims\", count(*) FILTER (annotator = 'B') AS \"llm_B_claims\", count(*) FILTER (annotator = 'C') AS \"llm_C_claims\", count(*) AS total_extracted, any_value(f.n) AS final_claims, round(count(*) / 3.0, 6) AS average_per_llm, round(any_value(f.n) * 100.0 / count(*), 6) AS retention_rate FROM ann, f",
    "chrono_sort": "SELECT o_custkey, o_orderkey AS pos, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus <> 'O' THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '9999-99-99' END DESC, CASE WHEN o_orderpriority <> '1-URGENT' THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '0000-00-00' END DESC, o_orderkey) AS rank FROM orders",
    "summary_condensed": f"SELECT doc_id AS article_id, source, CAST(coalesce(n, 0) AS INTEGER) AS n_claims, md5(first) AS first_claim_md5, coalesce(a.agents, '') AS agents, coalesce(a.types, '') AS types FROM documents LEFT JOIN (SELECT conv_id, count(*) AS n, arg_min(text, turn) AS first FROM conversations GROUP BY 1) c ON c.conv_id = doc_id LEFT JOIN (SELECT conv_id, string_agg(role, ',' ORDER BY role) AS agents, string_agg(kind, ',' ORDER BY role) AS types FROM (SELECT conv_id, role, arg_min({_KIND}, turn) AS kind FROM conversations WHERE role <> '' GROUP BY 1, 2) GROUP BY 1) a ON a.conv_id = doc_id",
    "summary_totals": "SELECT (SELECT count(*) FROM documents) AS num_articles, (SELECT count(*) FROM conversations WHERE conv_id IN (SELECT doc_id FROM documents)) AS num_claims, (SELECT count(*) FROM (SELECT DISTINCT conv_id, role FROM conversations WHERE role <> '' AND conv_id IN (SELECT doc_id FROM documents))) AS num_agents",
    "checkpoint_resume": "SELECT d.doc_id AS article_id, CASE WHEN l.doc_id IS NOT NULL THEN 'done' ELSE 'todo' END AS state FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 0 AND quality = 1) l ON l.doc_id = d.doc_id",
    "history_last_attempt": "SELECT user_id, count(*) AS attempts, max(event_id) AS last_attempt, arg_max(event_type, event_id) AS last_details FROM events GROUP BY 1",
    "topic_first_match": "SELECT doc_id, CASE WHEN contains(source, 'src1') THEN 'One' WHEN contains(source, 'src5') THEN 'Five' WHEN contains(source, '9') THEN 'Nine' END AS topic, CASE WHEN contains(source, 'src1') THEN 'Topic one' WHEN contains(source, 'src5') THEN 'Topic five' WHEN contains(source, '9') THEN 'Topic nine' END AS label FROM documents",
    "topic_stats": "SELECT source AS topic, count(*) AS articles, CAST(sum(n) AS BIGINT) AS claims, round(avg(n), 6) AS mean_claims, round(stddev_samp(n), 6) AS sd_claims, round(stddev_pop(n), 6) AS sd_pop_claims FROM (SELECT doc_id, source, (SELECT count(*) FROM conversations WHERE conv_id = doc_id) AS n FROM documents) GROUP BY 1",
    "eval_prf": f"SELECT tp, fp, fn, {_PRF} FROM (SELECT count(*) FILTER (n_chars < 1000 AND quality = 0) AS tp, count(*) FILTER (n_chars < 1000 AND quality <> 0) AS fp, count(*) FILTER (n_chars >= 1000 AND quality = 0) AS fn FROM labels JOIN documents USING (doc_id))",
    "claims_matched": f"SELECT tp, fp, fn, {_PRF} FROM (SELECT count(*) FILTER (a AND b) AS tp, count(*) FILTER (a AND NOT b) AS fp, count(*) FILTER (b AND NOT a) AS fn FROM (SELECT conv_id, role, bool_or(turn % 2 = 0) AS a, bool_or(role IN ('user', 'assistant')) AS b FROM conversations GROUP BY 1, 2))",
}
