"""Prompt texts that ask a model for a character's state or for the causes in a text, for an offline batch scorer, and
the counts of what came of stored texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts of the prompts around what is filled in: character, description, dialog; text, characters, place, time.
STATE_PARTS = (
    "Describe the state of mind of one character in a dialog.\nCharacter: ", "\nDescription: ", "\nDialog:\n",
    "\n\nAnswer with one JSON object:\nemotional_mix: list of {emotion_type, intensity 0 to 1, duration, triggers, manifestations}\ndominant_emotion: text\n"
    "trait_manifestations: map of trait to {strength 0 to 1, consistency 0 to 1, behavior_examples, situational_context}\nstability_score, intensity_level, arousal_level, analysis_confidence: 0 to 1\n",
)
CAUSAL_PARTS = (
    "List the events of a text and which of them cause others.\nText:\n", "\nCharacters: ", "\nPlace: ", "\nTime: ",
    "\n\nAnswer with one JSON object:\nevents: list of {event_name, event_type action, incident or outcome, participants, location, time}\n"
    "causal_relations: list of {cause_event, effect_event, relation_type causes, contributes_to, prevents, enables or requires, causal_strength, necessity_score, sufficiency_score and confidence 0 to 1, conditions, exceptions, evidence}\n",
)
UNKNOWN = "unknown"


def _filled(parts: tuple[str, ...], values: list[Column]) -> Column:
    cells = [F.coalesce(F.nullif(v.cast("string"), F.lit("")), F.lit(UNKNOWN)) for v in values]
    return F.concat(*[x for p, c in zip(parts, cells) for x in (F.lit(p), c)], F.lit(parts[-1]))


def state_prompt(character: Column, dialog: Column, description: Column | None = None) -> Column:
    return _filled(STATE_PARTS, [character, F.lit("") if description is None else description, dialog])


def causal_prompt(text: Column, characters: Column, place: Column, time: Column) -> Column:
    return _filled(CAUSAL_PARTS, [text, characters, place, time])


def ingest_stats(episodes: DataFrame, entities: DataFrame, relations: DataFrame, key: str = "session_id") -> DataFrame:
    """Per session the numbers of episodes, of entities found in them, and of relations made; 0 where there is none."""
    parts = {"episodes_added": episodes, "entities_extracted": entities, "relationships_created": relations}
    rows = [df.select(key, *[F.lit(int(c == name)).alias(c) for c in parts]) for name, df in parts.items()]
    return reduce(DataFrame.unionByName, rows).groupBy(key).agg(*[F.sum(c).alias(c) for c in parts])
