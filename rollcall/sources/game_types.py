"""Game types that come with a rank method."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
ELO_GAME_TYPES = (
    "DM", "CTF", "TDM", "DM*", "DM+", "DM++", "fng2", "fng2+", "iCTF*", "iCTF+", "iCTFX",
    "iDM*", "iDM+", "zCatch", "zCatch/TeeVi",
)
TIME_GAME_TYPES = (
    "DDraceNetwork", "Gores", "TestDDraceNetwor", "TestGores", "Race", "iDDRace", "XXLDDRace",
    "PPRace", "TestDDNet++",
)


def default_rank_methods(spark: SparkSession) -> DataFrame:
    rows = [(n, "ELO") for n in ELO_GAME_TYPES] + [(n, "TIME") for n in TIME_GAME_TYPES]
    pairs = F.array(*[
        F.struct(F.lit(n).alias("game_type"), F.lit(m).alias("rank_method")) for n, m in rows
    ])
    return spark.range(1).select(F.inline(pairs))
