"""What an event log means: entities, aliases and status tokens as parameters, and one preset."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Policy:
    """``canonical`` entities, ``aliases`` to them, entities that schedules may name but that
    are ignored, and the status tokens that make an update significant or planned."""

    scope: str
    canonical: tuple[str, ...]
    aliases: dict[str, str] = field(default_factory=dict)
    ignored: tuple[str, ...] = ()
    significant: tuple[str, ...] = ()
    planned: tuple[str, ...] = ()
    datasets: dict[int, str] = field(default_factory=dict)

    def problems(self) -> list[str]:
        """Why the policy cannot be used: tokens in both sets, aliases to no entity."""
        both = sorted(set(self.significant) & set(self.planned))
        lost = sorted(a for a, to in self.aliases.items() if to not in self.canonical)
        return [f"significant and planned: {t}" for t in both] + [f"alias of no entity: {a}" for a in lost]

    def status_table(self, spark: SparkSession) -> DataFrame:
        """(token, is_significant, is_planned); a constant of the policy."""
        tokens = sorted({*self.significant, *self.planned})
        return spark.createDataFrame([(t, int(t in self.significant), int(t in self.planned)) for t in tokens], "token string, is_significant int, is_planned int")

    def entity_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(e,) for e in self.canonical], "entity string")


# The entity list, aliases, dataset ids and status tokens of the transit preset.
TRANSIT = Policy(
    scope="NYCT Subway",
    canonical=("1", "2", "3", "4", "5", "6", "7", "A", "B", "C", "D", "E", "F", "FS", "G", "GS", "H", "J", "L", "M", "N", "Q", "R", "W", "Z"),
    aliases={"5X": "5", "6X": "6", "7X": "7", "FX": "F"},
    ignored=("SI",),
    significant=("delays", "severe-delays", "part-suspended", "suspended"),
    planned=("planned-work", "weekday-service", "weekend-service", "saturday-schedule", "sunday-schedule", "essential-service", "no-scheduled-service"),
    datasets={2021: "y63v-kht3", 2022: "rq86-r8pt", 2023: "7pnn-mafy", 2024: "ebrw-j62c", 2025: "q9nv-uegs", 2026: "g8es-h7gb"},
)
