"""Topic priority from previous papers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def paper_question_outer(papers: DataFrame, questions: DataFrame, topic_id: int) -> DataFrame:
    """All papers, with their questions on a topic where there are any."""
    on_topic = questions.where(F.col("topic_id") == topic_id).select("paper_id", "position")
    return papers.join(on_topic, "paper_id", "left")


def paper_totals(papers: DataFrame) -> DataFrame:
    return papers.groupBy("exam_id").agg(F.count("*").alias("exam_paper_count"))


def topic_occurrence_stats(papers: DataFrame, questions: DataFrame) -> DataFrame:
    """A row an exam and topic that occurs: papers in all, matched questions, matched papers, matched years.

    Questions are counted a paper and topic before they meet the papers, so a paper is joined once a topic; totals come
    from a grouping of their own, never from papers x topics.
    """
    per_paper = questions.groupBy("paper_id", "topic_id").agg(F.count("*").alias("n"))
    matched = per_paper.join(papers.select("paper_id", "exam_id", "year"), "paper_id")
    stats = matched.groupBy("exam_id", "topic_id").agg(
        F.sum("n").alias("matched_question_count"), F.count("*").alias("matched_paper_count"), F.array_sort(F.collect_set("year")).alias("matched_years")
    )
    return stats.join(paper_totals(papers), "exam_id")


def topic_priority(pairs: DataFrame, stats: DataFrame, totals: DataFrame, *, rule_version: str = "topic-priority-v1") -> DataFrame:
    """pairs: exam_id, topic_id, covered. Each pair with its statistics, band and two reason codes in order."""
    n, papers = F.col("matched_paper_count"), F.col("exam_paper_count")
    found = pairs.join(stats.drop("exam_paper_count"), ["exam_id", "topic_id"], "left").join(totals, "exam_id", "left").na.fill(0, ["matched_question_count", "matched_paper_count", "exam_paper_count"])
    band = F.when(~F.col("covered"), "LOW").when(n >= 2, "HIGH").otherwise("MEDIUM")
    coverage = F.when(F.col("covered"), "DIRECT_SYLLABUS_COVERAGE").otherwise("NOT_IN_SELECTED_SYLLABUS_VERSION")
    occurrence = F.when(papers == 0, "NO_PREVIOUS_PAPER_DATA").when(n >= 2, "REPEATED_IN_PREVIOUS_PAPERS").when(n == 1, "APPEARED_IN_PREVIOUS_PAPER").otherwise("NO_RECORDED_PREVIOUS_OCCURRENCE")
    return found.select(
        "exam_id", "topic_id", "covered", "exam_paper_count", "matched_question_count", "matched_paper_count",
        F.coalesce("matched_years", F.array().cast("array<bigint>")).alias("matched_years"),
        band.alias("band"), F.array(coverage, occurrence).alias("reasons"), F.lit(rule_version).alias("rule_version"),
    )
