"""Rewards of generations from test results, and advantages within a prompt's group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import evaluate, ranks

# Weights of the test types; others weigh 1.
TYPE_WEIGHTS = {"table": 2.0, "text_presence": 1.0, "text_absence": 1.5, "order": 1.5, "math": 2.0, "formatting": 0.5}


def weight_of(kind: Column, weights: dict[str, float] | None = None) -> Column:
    table = F.create_map(*[F.lit(x) for kv in (weights or TYPE_WEIGHTS).items() for x in kv])
    return F.coalesce(table[kind], F.lit(1.0))


def binary_reward(passed: Column, kind: Column, weights: dict[str, float] | None = None) -> Column:
    """1 if no test failed, also if there are none."""
    return F.when(F.count_if(passed.isNotNull() & ~passed) == 0, 1.0).otherwise(0.0)


def proportional_reward(passed: Column, kind: Column, weights: dict[str, float] | None = None) -> Column:
    """The share of tests passed; 0 without tests."""
    return F.coalesce(F.try_divide(F.count_if(passed), F.count(passed)), F.lit(0.0))


def weighted_reward(passed: Column, kind: Column, weights: dict[str, float] | None = None) -> Column:
    """The weight of tests passed over that of all; 0 without tests."""
    w = F.when(passed.isNotNull(), weight_of(kind, weights))
    return F.coalesce(F.try_divide(F.sum(F.when(passed, w).otherwise(0.0)), F.sum(w)), F.lit(0.0))


#: Strategies by name; add to it to have another.
STRATEGIES: dict[str, Callable[..., Column]] = {"binary": binary_reward, "proportional": proportional_reward, "weighted": weighted_reward}


def rewards(results: DataFrame, *by: str, strategy: str = "proportional", weights: dict[str, float] | None = None) -> DataFrame:
    """(by, reward) from rows with type and passed; a group whose rows have a null passed has no tests."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown reward strategy: {strategy}; there are {', '.join(STRATEGIES)}")
    return results.groupBy(*by).agg(STRATEGIES[strategy](F.col("passed"), F.col("type"), weights).alias("reward"))


def completion_rewards(completions: DataFrame, tests: DataFrame, strategy: str = "proportional", weights: dict[str, float] | None = None) -> DataFrame:
    """(pdf_name, page, gen_id, reward): each completion (pdf_name, page, gen_id, text) against the stored tests (PAGE_TEST)
    of its page, the same for all completions of a page; one whose page has no tests has the strategy's reward for none."""
    key = ["pdf_name", "page", "gen_id"]
    pairs = evaluate.join_tests(completions.select(*key, F.col("text").alias("ocr_text")), tests, outer=True)
    results = evaluate.evaluate(pairs).select(*key, "type", F.when(F.col("tested"), F.col("passed")).alias("passed"))
    return rewards(results, *key, strategy=strategy, weights=weights)


def advantages(df: DataFrame, *prompt: str, reward: str = "reward") -> DataFrame:
    """df with advantage: the reward less its group's mean over the population deviation; 0 where that is under 1e-8."""
    w = Window.partitionBy(*prompt)
    std = F.stddev_pop(reward).over(w)
    return df.withColumn("advantage", F.when(std < 1e-8, 0.0).otherwise((F.col(reward) - F.avg(reward).over(w)) / std))


def without_zero(df: DataFrame, col: str = "advantage") -> DataFrame:
    return df.where(F.abs(col) >= 1e-8)


def moving_average(df: DataFrame, value: str, order: str, n: int, *by: str, chunk: int = ranks.CHUNK) -> DataFrame:
    """df with moving_avg, the mean of the last n values; a group is cut into chunks that share n - 1 rows."""
    return ranks.moving(df, "moving_avg", F.avg(value), n, [order], *by, chunk=chunk)


def step_metrics(df: DataFrame, *prompt: str) -> DataFrame:
    """(prompt, reward_mean, reward_std, num_generations, num_updates, rewards) of each group."""
    return df.groupBy(*prompt).agg(F.avg("reward").alias("reward_mean"), F.stddev_pop("reward").alias("reward_std"), F.count("*").cast("int").alias("num_generations"), F.count_if(F.abs("advantage") >= 1e-8).cast("int").alias("num_updates"), F.transform(F.sort_array(F.collect_list(F.struct("gen_id", "reward"))), lambda x: x["reward"]).alias("rewards"))
