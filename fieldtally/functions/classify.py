"""Classification rules for reports, pixels, survey answers and users."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values ------------------------------------------------------------------
REPORT_TYPES = ["adult", "bite", "site"]
DENSITY_CLASSES = ["human_absence", "low_density", "medium_density", "high_density"]
TARGET_SPECIES = ["aegypti", "albopictus", "culex", "japonicus", "koreicus"]
LOW_ACCURACY_SPECIES = ["aegypti", "koreicus", "japonicus"]
SURVEY_PARTS = {71: "thorax", 72: "abdomen", 73: "leg"}
SURVEY_SPECIES = {1: "albopictus", 2: "aegypti", 3: "japonicus", 4: "koreicus"}
PART_WEIGHTS = {"thorax": 0.6, "abdomen": 0.3, "leg": 0.1}
ARCHETYPES_1 = ["sparse", "clustered", "multi-clustered", "sporadic"]
ARCHETYPES_2 = ["HQ-sparse", "HQ-clustered", "HQ-multi-clustered",
                "LQ-sparse", "LQ-clustered", "LQ-multi-clustered", "sporadic"]
# -------------------------------------------------------------------------------


def report_label(verdict: Column, validated: Column, hidden: Column) -> Column:
    """Label of a report from the experts' verdict; the first rule that holds wins."""
    shown = ~hidden

    def rule(value: str) -> Column:
        return shown & (verdict == value)

    return (
        F.when(rule("nosesabe") & (validated == 1), "not-sure")
        .when(rule("nosesabe") & (validated == 0), "unvalidated")
        .when(rule("noseparece"), "other_species")
        .when(rule("conflict"), "other_species")
        .when(rule("site"), "storm_drain")
        .when(rule("site#other"), "other_site")
        .when(hidden, "spam")
        .otherwise(verdict)
    )


def confidence_score(code: Column) -> Column:
    """Experts' confidence code (text) as a score."""
    return F.when(code == "1", 0.7).when(code == "2", 1.0).otherwise(0.0)


def bite_severity(count: Column) -> Column:
    return F.when(count <= 3, "low").when(count <= 10, "high").when(count > 10, "extreme")


def storm_drain_type(status: Column) -> Column:
    return F.when(status == "storm_drain_water", "with_water").when(status == "storm_drain_dry", "dry")


def density_class(people: Column) -> Column:
    """Class of a pixel by human presence; null for negative (no data) values."""
    return (
        F.when(people == 0, "human_absence")
        .when((people > 0) & (people < 50), "low_density")
        .when((people >= 50) & (people < 300), "medium_density")
        .when(people >= 300, "high_density")
    )


def survey_label(answer_id: Column) -> Column:
    """`part_species` of an answer; null for ids outside the questionnaire."""
    out = F.lit(None).cast("string")
    for part, part_name in SURVEY_PARTS.items():
        for species, species_name in SURVEY_SPECIES.items():
            out = F.when(answer_id == part * 10 + species, f"{part_name}_{species_name}").otherwise(out)
    return out


def part_weight(part: Column) -> Column:
    """Weight of a body part; 0 for any other."""
    out = F.lit(0.0)
    for name, weight in PART_WEIGHTS.items():
        out = F.when(part == name, weight).otherwise(out)
    return out


def target_species_flag(label: Column) -> Column:
    """0 for reports of other or unsure species, else 1 (also when the label is missing)."""
    return F.when(label.isin("other_species", "not-sure"), 0).otherwise(1)


def archetype(
    n_clusters: Column,
    spread: Column,
    quality: Column,
    spread_limit: float | None = 1000,
    quality_limit: float | None = 0.5,
) -> Column:
    """Behaviour label of a user from clusters, spread in metres and report quality.

    A missing cluster count means too few reports: `sporadic`, never prefixed. A missing
    spread or quality counts as below its limit.
    """
    if spread_limit is None:
        extent = F.lit("")
    else:
        extent = F.when(spread >= spread_limit, " wide").otherwise(" narrow")
    base = (
        F.when(n_clusters == 0, F.concat(F.lit("sparse"), extent))
        .when(n_clusters == 1, F.concat(F.lit("clustered"), extent))
        .when(n_clusters > 1, F.lit("multi-clustered"))
    )
    if quality_limit is not None:
        grade = F.when(quality >= quality_limit, "HQ-").otherwise("LQ-")
        base = F.concat(grade, base)
    return F.coalesce(base, F.lit("sporadic"))
