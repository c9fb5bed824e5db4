"""Structured queries: clauses on fields, combined by must, should and must not.

A field is held as its canonical text (tokens joined by blanks). Terms, prefixes and phrases are then containment tests on that text with a
blank at either end, which stay inside generated code and need no token arrays."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import tokens

FIELDS = ("body", "title", "heading", "filename", "path", "content_name", "sheet", "email_subject")
OCCURS = ("must", "should", "must_not")
MATCHES = ("term", "prefix", "phrase")


class RequestError(ValueError):
    """A request that breaks a rule; ``code`` names the rule."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


@dataclass(frozen=True)
class Clause:
    id: str
    text: str
    occur: str = "must"
    match: str = "term"
    fields: tuple[str, ...] = ()

    @property
    def searched(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(self.fields)) or FIELDS

    @property
    def words(self) -> list[str]:
        return tokens(self.text)


@dataclass(frozen=True)
class SearchRequest:
    """A search in one of three modes, with the limits the service keeps."""

    clauses: tuple[Clause, ...] = ()
    minimum_should_match: int = 0
    semantic_query: str | None = None
    mode: str = "hybrid"  # keyword, semantic or hybrid
    scope: str = "passage"  # passage or section
    candidate_limit: int = 200
    group_limit: int = 20
    groups_per_document: int = 5
    previews_per_group: int = 2
    similarity_threshold: float = 0.0
    strict_threshold: bool = False
    diversify_previews: bool = False
    weights: Mapping[str, float] = field(default_factory=lambda: {"keyword": 1.0, "semantic": 1.0})
    field_weights: Mapping[str, float] = field(default_factory=lambda: dict(DEFAULT_WEIGHTS))

    def validate(self) -> SearchRequest:
        def rule(ok: bool, code: str, message: str) -> None:
            if not ok:
                raise RequestError(code, message)

        rule(self.mode in ("keyword", "semantic", "hybrid"), "invalid_mode", self.mode)
        rule(self.scope in ("passage", "section"), "invalid_scope", self.scope)
        rule(1 <= self.candidate_limit <= 10_000, "invalid_candidate_limit", "1 to 10000")
        rule(1 <= self.group_limit <= 100, "invalid_group_limit", "1 to 100")
        rule(1 <= self.groups_per_document <= self.group_limit, "invalid_groups_per_document", "1 to the group limit")
        rule(1 <= self.previews_per_group <= 20, "invalid_previews", "1 to 20")
        rule(len(self.clauses) <= 64, "too_many_clauses", "64 at most")
        ids = [c.id for c in self.clauses]
        rule(len(set(ids)) == len(ids) and all(ids), "invalid_clause_id", "clauses have different, non-empty ids")
        for c in self.clauses:
            rule(c.occur in OCCURS, "invalid_occur", c.id)
            rule(c.match in MATCHES, "invalid_match", c.id)
            rule(all(f in FIELDS for f in c.fields), "invalid_field", c.id)
            n = len(c.words)
            rule(n > 0, "empty_clause", c.id)
            rule(c.match == "phrase" or n == 1, "not_one_term", f"{c.id} has {n} tokens; use a phrase")
        should = sum(c.occur == "should" for c in self.clauses)
        rule(0 <= self.minimum_should_match <= should, "invalid_minimum_should_match", f"0 to {should}")
        if self.mode != "semantic":
            rule(any(c.occur != "must_not" for c in self.clauses), "no_positive_clause", "a keyword search needs a must or should clause")
        if self.mode != "keyword":
            rule(bool(self.semantic_query and self.semantic_query.strip()), "no_semantic_query", "a semantic search needs a query text")
        else:
            rule(not self.semantic_query and not self.strict_threshold, "no_effect", "semantic options do nothing in a keyword search")
        rule(0.0 <= self.similarity_threshold <= 1.0, "invalid_threshold", "0 to 1")
        rule(all(0 <= w <= 10 for w in self.field_weights.values()) and any(self.field_weights.values()), "invalid_field_weight", "0 to 10, not all 0")
        rule(all(w >= 0 for w in self.weights.values()) and any(self.weights.values()), "invalid_branch_weight", "not negative, not all 0")
        return self


#: Default weight of each field in keyword ranking (fixed values).
DEFAULT_WEIGHTS = {"body": 1.0, "title": 3.0, "heading": 2.0, "filename": 2.5, "path": 0.5, "content_name": 2.5, "sheet": 1.5, "email_subject": 3.0}


def field_hit(clause: Clause, canonical: Column) -> Column:
    """Whether a clause matches a field's canonical text; never null."""
    words = " ".join(clause.words)
    held = F.concat(F.lit(" "), canonical, F.lit(" "))
    sought = f" {words}" if clause.match == "prefix" else f" {words} "
    return F.coalesce(F.contains(held, F.lit(sought)), F.lit(False)) if words else F.lit(False)


def clause_hit(clause: Clause, fields: Mapping[str, Column]) -> Column:
    """Whether a clause matches any of its fields that there are."""
    out = F.lit(False)
    for f in clause.searched:
        if f in fields:
            out = out | field_hit(clause, fields[f])
    return out


@dataclass
class Evaluation:
    """Columns of a query's evaluation."""

    matches: Column
    hits: dict[str, Column]
    should_matched: Column
    candidate: Column  # what the index finds: should clauses are alternatives there, however many must match


def evaluate(clauses: Sequence[Clause], fields: Mapping[str, Column], minimum_should_match: int = 0) -> Evaluation:
    """must, should and must not over columns of canonical text: every must, no must not, at least so many should clauses."""
    return combine(clauses, {c.id: clause_hit(c, fields) for c in clauses}, minimum_should_match)


def combine(clauses: Sequence[Clause], hits: dict[str, Column], minimum_should_match: int = 0) -> Evaluation:
    """:func:`evaluate` from what each clause hits."""
    musts = [hits[c.id] for c in clauses if c.occur == "must"]
    shoulds = [hits[c.id] for c in clauses if c.occur == "should"]
    nots = [hits[c.id] for c in clauses if c.occur == "must_not"]
    base = F.lit(True)
    for h in musts:
        base = base & h
    for h in nots:
        base = base & ~h
    count = F.lit(0)
    for h in shoulds:
        count = count + h.cast("int")
    found = base
    if shoulds and (not musts or minimum_should_match > 0):
        found = found & (count >= 1)
    return Evaluation(base & (count >= minimum_should_match), hits, count, found)


def matched_ids(clauses: Sequence[Clause], hits: Mapping[str, Column]) -> Column:
    """Ids of the positive clauses that match, in the clauses' order."""
    return F.array_compact(F.array(*[F.when(hits[c.id], F.lit(c.id)) for c in clauses if c.occur != "must_not"])) if clauses else F.array().cast("array<string>")


def optional_boost(clauses: Sequence[Clause], minimum_should_match: int, fields: Mapping[str, Column]) -> Column | None:
    """The second branch: rows with every must and at least one should clause, where should clauses are only optional."""
    if not has_boost(clauses, minimum_should_match):
        return None
    e = evaluate(clauses, fields, 1)
    return e.matches


def has_boost(clauses: Sequence[Clause], minimum_should_match: int) -> bool:
    """Whether should clauses are only optional, so that a second branch looks for them."""
    return minimum_should_match <= 0 and any(c.occur == "must" for c in clauses) and any(c.occur == "should" for c in clauses)
