"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Ranks, lowest first in each use.
SEVERITY_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3}
THRESHOLD_RANK = {"low": 1, "medium": 2, "high": 3, "critical": 4}
APPLICABILITY_RANK = {"uncertain": 0, "matched": 1, "informational": 2, "universal": 2}

#: Patterns of a concrete instruction.
CONCRETE = [
    r"\brename\b.+\bto\b",
    r"\breplace\b.+\bwith\b",
    r"\bremove\b.+\b(import|class|method|annotation)\b",
    r"\badd\b.+\bto\b",
    r"(before|after)\s*[:\->]",
    r"→|->|=>",
    r"`[^`]+`\s*(→|->|=>|to)\s*`[^`]+`",
    r"\bfrom\b.+\bto\b.+\bimport\b",
]

#: Sections and the change type and confidence they stand for.
SECTION_TYPES = [
    (r"breaking", "breaking", "confirmed"),
    (r"deprecat", "deprecation", "confirmed"),
    (r"mandatory|migration|upgrade guide", "mandatory_migration", "confirmed"),
    (r"dependency|bom|component", "dependency_upgrade", "inferred"),
    (r"security|cve", "mandatory_migration", "confirmed"),
    (r"behavior", "behavioral", "inferred"),
]

#: Rule types of source sections.
RULE_TYPES = {
    "breaking_change": "breaking",
    "security_fix": "mandatory_migration",
    "component_upgrade": "mandatory_migration",
    "security_config": "mandatory_migration",
    "behavioral": "behavioral",
    "deprecation": "deprecation",
    "new_capability": "behavioral",
}

#: Entity kinds, their node label and edge type.
LABELS = {"class": "Class", "property": "ApplicationProperty", "dependency": "Dependency"}
EDGES = {"class": "AFFECTS_CLASS", "property": "AFFECTS_PROPERTY", "dependency": "AFFECTS_DEPENDENCY"}

#: Name prefixes that a context keeps.
ALLOWED_PREFIXES = (
    "org.springframework", "jakarta.", "javax.", "org.hibernate", "io.micrometer", "io.projectreactor", "org.thymeleaf",
    "com.fasterxml.jackson", "tools.jackson", "org.springdoc", "com.querydsl", "org.flywaydb", "org.liquibase",
    "org.apache.tomcat", "org.eclipse.jetty", "io.undertow", "org.springframework.cloud", "spring.",
)

#: Words that make an ad-hoc query a mutation.
MUTATIONS = r"\b(CREATE|MERGE|SET|DELETE|REMOVE|DROP)\b"

#: Issue key prefixes.
ISSUE_PREFIXES = ("WFLY", "WFCORE", "WFMP", "JBEAP", "EAP7", "UNDERTOW", "HAL", "ISPN", "HHH")


def lookup(value: Column, table: dict, default=None) -> Column:
    """A CASE over a fixed table."""
    out = F
    for key, to in table.items():
        out = out.when(value == key, F.lit(to))
    return out.otherwise(F.lit(default))


def rule_type(section: Column) -> Column:
    """Rule type of a source section; an unknown one fails the query."""
    unknown = F.raise_error(F.concat(F.lit("unrecognized source section "), F.coalesce(section, F.lit("null"))))
    return F.coalesce(lookup(section, RULE_TYPES), unknown.cast("string"))


def equals_or_any(column: Column, value) -> Column:
    """Optional equality: everything passes without a value."""
    return F.lit(True) if value is None else F.coalesce(column == F.lit(value), F.lit(False))


def between_or_open(column: Column, low=None, high=None) -> Column:
    """Closed range, either bound of which may be left open."""
    from_low = F.lit(True) if low is None else column >= low
    to_high = F.lit(True) if high is None else column <= high
    return F.coalesce(from_low & to_high, F.lit(False))


def mentions(keyword: str, *texts: Column) -> Column:
    """A keyword stands in one of the texts, in any case."""
    found = F.lit(False)
    for text in texts:
        found = found | F.coalesce(F.contains(F.lower(text), F.lit(keyword.lower())), F.lit(False))
    return found


def severity_rank(severity: Column) -> Column:
    """0 for critical up to 3 for low; 4 for anything else."""
    return lookup(severity, SEVERITY_RANK, 4)


def at_least(severity: Column, threshold: str | None) -> Column:
    """Severity, in any case, reaches the threshold; null and empty ones fail unless there is none."""
    if not threshold:
        return F.lit(True)
    reached = lookup(F.lower(severity), THRESHOLD_RANK, 0) >= THRESHOLD_RANK.get(threshold.lower(), 0)
    return F.coalesce(reached & (severity != ""), F.lit(False))


def applicability(affected: Column, matches: Column, rank: Column, scanned: Column, forced: Column | None = None) -> Column:
    out = F.when(affected == 0, "informational").when(~scanned, "universal").when(matches > 0, "matched")
    if forced is not None:
        out = out.when(forced > 0, "matched")
    return out.when(rank <= 1, "uncertain").otherwise("excluded")


def is_concrete(text: Column) -> Column:
    out = F.lit(False)
    for pattern in CONCRETE:
        out = out | text.rlike(f"(?i){pattern}")
    return F.coalesce((F.trim(text) != "") & out, F.lit(False))


def executor(recipe: Column, auto: Column, missing: Column, effort: Column, instruction: Column, applicable: Column) -> Column:
    """The track that carries a step out; a recipe of unknown automation falls through to the effort rows.

    Unknown missing parameters are none; effort is read in any case.
    """
    missing = F.coalesce(missing, F.lit(False))
    return (
        F.when(recipe.isNotNull() & auto & ~missing, "openrewrite")
        .when(recipe.isNotNull() & (~auto | missing), "prompted-auto")
        .when(F.lower(effort).isin("mechanical", "moderate") & is_concrete(instruction) & (applicable == "matched"), "agent-codemod")
        .otherwise("human-review")
    )


def classify(section: Column, text: Column) -> tuple[Column, Column]:
    """(change type, confidence) by the first section pattern that fits."""
    both = F.concat_ws(" ", section, text)
    kind = confidence = F
    for pattern, change, sure in SECTION_TYPES:
        fits = both.rlike(f"(?i){pattern}")
        kind, confidence = kind.when(fits, change), confidence.when(fits, sure)
    cli = F.contains(text, F.lit("/subsystem="))
    return kind.when(cli, "mandatory_migration").otherwise("behavioral"), confidence.when(cli, "confirmed").otherwise("inferred")


def stability(body: Column) -> Column:
    low = F.lower(body)
    return F.when(F.contains(low, F.lit("[experimental]")), "experimental").when(F.contains(low, F.lit("[preview]")), "preview").when(F.contains(low, F.lit("[community]")), "community")


def sortable(version: Column) -> Column:
    """major * 10**6 + minor * 10**3 + patch of two or three numeric parts; null otherwise."""
    ok = version.rlike(r"^\d+\.\d+(\.\d+)?$")
    part = lambda i: F.coalesce(F.get(F.split(version, r"\."), F.lit(i)).try_cast("long"), F.lit(0))
    return F.when(ok, part(0) * 1000000 + part(1) * 1000 + part(2))


def bucket(name: Column) -> Column:
    """Scan bucket of a name: coordinates, class, property, simple name or artifact."""
    last = F.element_at(F.split(name, r"\."), -1)
    return (
        F.when(F.contains(name, F.lit(":")), "deps_ga")
        .when(F.contains(name, F.lit(".")), F.when(last.rlike(r"^\p{Lu}"), "classes").otherwise("props"))
        .when(name.rlike(r"^\p{Lu}"), "class_simple")
        .otherwise("dep_artifacts")
    )


def allowed(name: Column) -> Column:
    group = F.substring_index(name, ":", 1)
    out = F.lit(False)
    for prefix in ALLOWED_PREFIXES:
        out = out | F.startswith(group, F.lit(prefix))
    return out


def is_mutation(query: Column) -> Column:
    upper = F.upper(query)
    return upper.rlike(MUTATIONS) | upper.rlike(r"^\s*CALL DB")
