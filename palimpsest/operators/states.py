"""Sequence analytics over character states: differences, transitions, coherence.

States: character_id, state_id, observed_at, emotions map<string,double>, traits map<string,double>, dominant,
stability, intensity, arousal. `digits` rounds deltas and means before they meet a threshold; None leaves them raw.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The thresholds, weights and labels of this module are fixed values.
CALM, LIVELY = ("joy", "happiness"), ("optimistic", "enthusiastic", "anxious", "aggressive", "stubborn")


def _rounded(c: Column, digits: int | None) -> Column:
    return c if digits is None else F.round(c, digits)


def previous(states: DataFrame) -> DataFrame:
    """Adds prev (struct) of the character's state before; null for the first one."""
    order = Window.partitionBy("character_id").orderBy("observed_at", "state_id")
    own = F.struct("state_id", "observed_at", "emotions", "traits", "stability")
    return states.withColumn("prev", F.lag(own).over(order))


def emotion_changes(old: Column, new: Column, digits: int | None = None) -> Column:
    """array<struct(name, old, new, delta)> by name; a missing emotion counts 0."""
    zipped = F.map_zip_with(old, new, lambda _, a, b: F.struct(F.coalesce(a, F.lit(0.0)).alias("old"), F.coalesce(b, F.lit(0.0)).alias("new")))
    return _changes(zipped, digits)


def trait_changes(old: Column, new: Column, digits: int | None = None) -> Column:
    """The same for traits that both states have."""
    zipped = F.map_zip_with(old, new, lambda _, a, b: F.struct(a.alias("old"), b.alias("new")))
    return _changes(F.map_filter(zipped, lambda _, v: v["old"].isNotNull() & v["new"].isNotNull()), digits)


def _changes(zipped: Column, digits: int | None) -> Column:
    kept = F.filter(F.map_entries(zipped), lambda e: e["value"]["old"] != e["value"]["new"])
    return F.array_sort(F.transform(kept, lambda e: F.struct(e["key"].alias("name"), e["value"]["old"].alias("old"), e["value"]["new"].alias("new"), _rounded(e["value"]["new"] - e["value"]["old"], digits).alias("delta"))))


def transition_type(emotions: Column, traits: Column, stability: Column) -> Column:
    return (
        F.when((F.size(emotions) == 0) & (F.size(traits) == 0), "stable")
        .when(F.abs(stability) > 0.3, "sudden_shift").when(F.abs(stability) > 0.1, "gradual_change").otherwise("evolution")
    )


def transition_reason(emotions: Column, traits: Column, stability: Column) -> Column:
    def word(delta: Column) -> Column:
        return F.when(delta > 0, "增强").otherwise("减弱")

    feelings = F.transform(emotions, lambda e: F.when(F.abs(e["delta"]) > 0.3, F.concat(F.lit("情绪'"), e["name"], F.lit("'显著"), word(e["delta"]))).when(F.abs(e["delta"]) > 0.1, F.concat(F.lit("情绪'"), e["name"], F.lit("'"), word(e["delta"]))))
    habits = F.transform(traits, lambda t: F.when(F.abs(t["delta"]) > 0.2, F.concat(F.lit("特质'"), t["name"], F.lit("'强度显著"), word(t["delta"]))))
    calm = F.array(F.when(F.abs(stability) > 0.2, F.concat(F.lit("心理稳定性"), F.when(stability > 0, "提升").otherwise("下降"))))
    joined = F.array_join(F.array_compact(F.concat(feelings, habits, calm)), "; ")
    return F.when(joined == "", "自然演化").otherwise(joined)


def _mean(changes: Column, digits: int | None) -> Column:
    total = F.aggregate(changes, F.lit(0.0), lambda s, c: s + F.abs(c["delta"]))
    return F.coalesce(_rounded(total / F.nullif(F.size(changes), F.lit(0)), digits), F.lit(0.0))


def rationality(emotions: Column, traits: Column, stability: Column, digits: int | None = None) -> Column:
    mean, top = _mean(emotions, digits), F.coalesce(F.array_max(F.transform(emotions, lambda e: F.abs(e["delta"]))), F.lit(0.0))
    score = F.lit(1.0) - F.when(mean > 0.4, 0.3).when(mean > 0.2, 0.1).otherwise(0.0)
    score = score - F.when(top > 0.6, 0.2).otherwise(0.0) - F.when(_mean(traits, digits) > 0.3, 0.2).otherwise(0.0)
    score = score - F.when(F.abs(stability) > 0.2, 0.2).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def differences(states: DataFrame, digits: int | None = None) -> DataFrame:
    """Consecutive states: character_id, from_state, to_state, observed_at, emotion_changes, trait_changes, stability_change."""
    return compared(previous(states).where("prev is not null"), digits)


def compared(rows: DataFrame, digits: int | None = None) -> DataFrame:
    """The differences of states that have `prev`."""
    return rows.select(
        "character_id", F.col("prev.state_id").alias("from_state"), F.col("state_id").alias("to_state"), "observed_at",
        emotion_changes(F.col("prev.emotions"), F.col("emotions"), digits).alias("emotion_changes"),
        trait_changes(F.col("prev.traits"), F.col("traits"), digits).alias("trait_changes"),
        _rounded(F.col("stability") - F.col("prev.stability"), digits).alias("stability_change"),
    )


def transitions(states: DataFrame, trigger: str = "对话", digits: int | None = None) -> DataFrame:
    """Differences with type, reason, rationality and description of each transition."""
    return described(differences(states, digits), trigger, digits)


def described(changes: DataFrame, trigger: str = "对话", digits: int | None = None) -> DataFrame:
    """Differences to transition records."""
    e, t, s = F.col("emotion_changes"), F.col("trait_changes"), F.col("stability_change")
    rows = changes.withColumns({
        "transition_type": transition_type(e, t, s), "transition_reason": transition_reason(e, t, s), "rationality_score": rationality(e, t, s, digits), "trigger_event": F.lit(trigger),
    })
    return rows.withColumn("description", transition_description())


def transition_description() -> Column:
    return F.concat_ws(
        "\n", F.concat(F.lit("转移类型: "), "transition_type"), F.concat(F.lit("触发事件: "), "trigger_event"), F.concat(F.lit("转移原因: "), "transition_reason"),
        F.concat(F.lit("合理性得分: "), F.format_string("%.2f", "rationality_score")), F.concat(F.lit("转移时间: "), F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm:ss")),
        F.concat(F.lit("从状态: "), F.col("from_state").cast("string")), F.concat(F.lit("到状态: "), F.col("to_state").cast("string")),
    )


def state_description() -> Column:
    """Dominant emotion, up to five emotions and traits by name, and the three scores."""
    def listed(column: str) -> Column:
        return F.array_join(F.transform(F.slice(F.array_sort(F.map_entries(column)), 1, 5), lambda e: F.concat(e["key"], F.lit("("), F.format_string("%.2f", e["value"]), F.lit(")"))), ", ")

    scores = F.format_string("稳定性: %.2f, 强度: %.2f, 唤醒: %.2f", "stability", "intensity", "arousal")
    return F.concat_ws("\n", F.concat(F.lit("主导情绪: "), "dominant"), F.when(F.size("emotions") > 0, F.concat(F.lit("情绪混合: "), listed("emotions"))), F.when(F.size("traits") > 0, F.concat(F.lit("特质表现: "), listed("traits"))), scores)


def look_back(states: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """States of the `days` up to a time, those that were no longer valid then left out if there is a `valid_until`."""
    end = F.lit(as_of).cast("timestamp")
    rows = states.where((F.col("observed_at") <= end) & (F.col("observed_at") >= end - F.make_dt_interval(days=F.lit(days))))
    return rows.where(F.col("valid_until").isNull() | (F.col("valid_until") > end)) if "valid_until" in states.columns else rows


def history(states: DataFrame, limit: int = 50) -> DataFrame:
    """The newest `limit` states of each character, with their rank."""
    newest = Window.partitionBy("character_id").orderBy(F.desc("observed_at"), F.desc("state_id"))
    return states.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= limit)


def trait_consistency(states: DataFrame) -> DataFrame:
    """(character_id, trait_consistency): mean over traits seen more than once of max(0, 1 - 2 variance)."""
    rows = states.select("character_id", F.explode("traits").alias("trait", "strength"))
    per = rows.groupBy("character_id", "trait").agg(F.var_pop("strength").alias("v"), F.count("*").alias("n")).where("n > 1")
    return per.groupBy("character_id").agg(F.avg(F.greatest(F.lit(0.0), 1 - 2 * F.col("v"))).alias("trait_consistency"))


def emotion_rationality(states: DataFrame, digits: int | None = None) -> DataFrame:
    rows = differences(states, digits)
    top = F.coalesce(F.array_max(F.transform("emotion_changes", lambda e: F.abs(e["delta"]))), F.lit(0.0))
    return rows.groupBy("character_id").agg(F.avg(_change_score(top)).alias("emotional_rationality"))


def _change_score(top: Column) -> Column:
    """Of the largest change of an emotion."""
    return F.when(top < 0.3, 1.0).when(top < 0.6, 0.7).otherwise(0.4)


def behavior_score() -> Column:
    """Of one state, by its strongest trait (ties: the first by name)."""
    ranked = F.array_sort(F.transform(F.map_entries("traits"), lambda e: F.struct((-e["value"]).alias("s"), e["key"].alias("name"))))
    top = F.try_element_at(ranked, F.lit(1))["name"]
    return F.when(top.isNull() | F.col("dominant").isNull(), 0.5).when(top.isin(*CALM), 1.0).when(top.isin(*LIVELY), 0.9).otherwise(0.7)


def behavior_consistency(states: DataFrame) -> DataFrame:
    return states.groupBy("character_id").agg(F.avg(behavior_score()).alias("behavioral_consistency"))


def memory_score(intensity: Column, stability: Column, digits: int | None = None) -> Column:
    """Of mean values."""
    i, s = _rounded(intensity, digits), _rounded(stability, digits)
    return F.when((i > 0.7) & (s < 0.5), 0.6).when((i > 0.5) & (s < 0.7), 0.8).otherwise(0.9)


def memory_rationality(states: DataFrame, digits: int | None = None) -> DataFrame:
    return states.groupBy("character_id").agg(memory_score(F.avg("intensity"), F.avg("stability"), digits).alias("memory_rationality"))


def stored(states: DataFrame, key: str = "character_id") -> DataFrame:
    """What storing each state answers: state_id, episode_id, episode_name, source_description, success and error.

    states: key, observed_at, ok (false for a state that could not be read), body. Only good ones get an episode.
    """
    who = F.col(key).cast("string")
    ok = F.coalesce(F.col("ok"), F.lit(False)) & F.col("observed_at").isNotNull()
    seconds = F.unix_seconds("observed_at").cast("string")
    episode = F.sha2(F.concat_ws("|", who, seconds, F.coalesce("body", F.lit(""))).cast("binary"), 256)
    return states.select(
        *states.columns, F.when(ok, F.concat(F.lit("psych_state_"), who, F.lit("_"), seconds)).alias("stored_id"), F.when(ok, episode).alias("episode_id"),
        F.concat(F.lit("Psychological State - "), who).alias("episode_name"), F.concat(F.lit("psychological_state:"), who).alias("source_description"), ok.alias("success"), F.when(~ok, "unreadable state").alias("error"),
    )


def coherence(states: DataFrame, as_of: str, days: int = 7, limit: int = 100, digits: int | None = None) -> DataFrame:
    """The four scores and their weighted sum for every character with states in the window; one state gives 1.0."""
    rows = previous(history(look_back(states, as_of, days), limit).drop("rank"))
    top = F.coalesce(F.array_max(F.transform(emotion_changes(F.col("prev.emotions"), F.col("emotions"), digits), lambda e: F.abs(e["delta"]))), F.lit(0.0))
    rows = rows.withColumns({"_e": F.when(F.col("prev").isNotNull(), _change_score(top)), "_b": behavior_score()})
    # One row of each state without a trait beside those by trait: all scores come from one pass, on the partitions by
    # character that the windows have made.
    none = F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("double").alias("value"))
    rows = rows.select("character_id", "intensity", "stability", "_e", "_b", F.explode(F.concat(F.array(none), F.map_entries("traits"))).alias("t"))
    per = rows.groupBy("character_id", F.col("t.key").alias("trait")).agg(*[F.avg(c).alias(c) for c in ("_e", "_b", "intensity", "stability")], F.var_pop("t.value").alias("_v"), F.count("*").alias("_n"))
    state = lambda c: F.max(F.when(F.col("trait").isNull(), F.col(c)))
    spread = F.when(F.col("trait").isNotNull() & (F.col("_n") > 1), F.greatest(F.lit(0.0), 1 - 2 * F.col("_v")))
    out = per.groupBy("character_id").agg(
        state("_n").alias("n_states"), F.avg(spread).alias("trait_consistency"), state("_e").alias("emotional_rationality"), state("_b").alias("behavioral_consistency"),
        memory_score(state("intensity"), state("stability"), digits).alias("memory_rationality"))
    return _overall(out)


def _overall(out: DataFrame) -> DataFrame:
    """Scores that are not known, or of one state only, are 1; and their weighted sum."""
    names = ("trait_consistency", "emotional_rationality", "behavioral_consistency", "memory_rationality")
    out = out.withColumns({c: F.when(F.col("n_states") < 2, 1.0).otherwise(F.coalesce(c, F.lit(1.0))) for c in names})
    total = sum((w * F.col(c) for w, c in zip((0.3, 0.3, 0.2, 0.2), names)), F.lit(0.0))
    return out.withColumn("overall", F.when(F.col("n_states") < 2, 1.0).otherwise(total))


def rolling_coherence(states: DataFrame, days: int = 7, digits: int | None = None, span: int = 28) -> DataFrame:
    """A row for every state: the scores of its character's states of the `days` up to it, as `coherence` gives them as of
    its time (without a limit on their number).

    Range frames over moments that add up (counts, sums, sums of squares by trait) take the place of a window read whole
    for each state. A trait that a state does not show keeps its moments from the states before: all traits of a
    character's span stand beside each of its states. Time is cut into spans of `span` days, at least `days`, and states of
    the last `days` of a span stand in the next one too, so a character's history is many groups. Of states at one time
    each sees all. States without character or time have no row.
    """
    if span < days:
        raise ValueError("a span must be at least as long as the window")
    second, width = 86400, days * 86400
    rows = states.where("character_id is not null and observed_at is not null").withColumn("_t", F.unix_seconds(F.col("observed_at").cast("timestamp")))
    own = F.floor(F.col("_t") / (span * second))
    late = (own + 1) * (span * second) - F.col("_t") <= width
    copies = F.array_compact(F.array(F.struct(own.alias("span"), F.lit(True).alias("own")), F.when(late, F.struct((own + 1).alias("span"), F.lit(False).alias("own")))))
    rows = rows.select("character_id", "state_id", "observed_at", "emotions", "traits", "dominant", "intensity", "stability", "_t", F.explode(copies).alias("_in"))
    group = Window.partitionBy("character_id", "_in.span")
    order = group.orderBy("_t", "state_id")
    top = F.coalesce(F.array_max(F.transform(emotion_changes(F.col("_prev.emotions"), F.col("emotions"), digits), lambda e: F.abs(e["delta"]))), F.lit(0.0))
    rows = rows.withColumns({"_prev": F.lag(F.struct("emotions")).over(order), "_r": F.row_number().over(order), "_names": F.array_distinct(F.flatten(F.collect_set(F.map_keys("traits")).over(group)))})
    rows = rows.withColumns({"_e": F.when(F.col("_prev").isNotNull(), _change_score(top)), "_b": behavior_score()})
    frame = group.orderBy("_t").rangeBetween(-width, 0)
    n = F.count("*").over(frame)
    # The first state of a window has no state before it there.
    first = F.coalesce(F.min_by("_e", F.struct("_t", "state_id")).over(frame), F.lit(0.0))
    rows = rows.withColumns({
        "n_states": n, "emotional_rationality": (F.coalesce(F.sum("_e").over(frame), F.lit(0.0)) - first) / F.nullif(n - 1, F.lit(0)), "behavioral_consistency": F.avg("_b").over(frame),
        "memory_rationality": memory_score(F.avg("intensity").over(frame), F.avg("stability").over(frame), digits),
    })
    kept = ("character_id", "state_id", "observed_at", "n_states", "emotional_rationality", "behavioral_consistency", "memory_rationality")
    shown = rows.select(*kept, "_in", "_r", "_t", "traits", F.explode_outer("_names").alias("trait")).withColumn("_v", F.try_element_at("traits", F.col("trait")))
    of_trait = Window.partitionBy("character_id", "_in.span", "trait").orderBy("_t").rangeBetween(-width, 0)
    count, mean, square = F.count("_v").over(of_trait), F.avg("_v").over(of_trait), F.avg(F.col("_v") * F.col("_v")).over(of_trait)
    spread = F.when(count > 1, F.greatest(F.lit(0.0), 1 - 2 * F.greatest(square - mean * mean, F.lit(0.0))))
    out = shown.withColumn("_s", spread).where("_in.own").groupBy("character_id", "_in.span", "_r").agg(F.avg("_s").alias("trait_consistency"), *[F.first(c).alias(c) for c in kept[1:]])
    return _overall(out).select(*kept[:4], "trait_consistency", *kept[4:], "overall")
