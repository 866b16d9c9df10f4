"""Extension points: steps, single-step templates and index templates.

A step is a function from DataFrame to DataFrame with declarations; the
declarations are the rows of the lineage rules and extension routes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tarn.schema import LINEAGE_STEPS

StepFn = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Step:
    """``index_mode`` is ``text``, ``lexical`` or none."""

    name: str
    input_format: str
    output_format: str
    required_input_reps: tuple[str, ...]
    output_reps: tuple[str, ...]
    transform: StepFn
    index_mode: str | None = None


@dataclass(frozen=True)
class Template:
    """A step chosen by file extension."""

    name: str
    extensions: tuple[str, ...]
    entity_type: str
    step: str


@dataclass(frozen=True)
class IndexTemplate:
    """How to build an index from chunks and how to search it."""

    name: str
    build: StepFn
    search: Callable[..., DataFrame]


class Registry:
    """Named extensions; a name is taken once and has to exist to be removed."""

    def __init__(self) -> None:
        self.items: dict[str, dict[str, Step | Template | IndexTemplate]] = {
            "step": {}, "template": {}, "index": {},
        }

    @staticmethod
    def _kind(item: Step | Template | IndexTemplate) -> str:
        return {Step: "step", Template: "template", IndexTemplate: "index"}[type(item)]

    def register(self, item: Step | Template | IndexTemplate) -> None:
        known = self.items[self._kind(item)]
        if item.name in known:
            raise ValueError(f"{self._kind(item)} {item.name!r} is already registered")
        known[item.name] = item

    def unregister(self, kind: str, name: str) -> None:
        if name not in self.items[kind]:
            raise KeyError(f"no {kind} {name!r}")
        del self.items[kind][name]

    def get(self, kind: str, name: str) -> Step | Template | IndexTemplate:
        if name not in self.items[kind]:
            raise KeyError(f"no {kind} {name!r}")
        return self.items[kind][name]

    def for_extension(self, ext: str) -> Template | None:
        """The template of an extension, case ignored."""
        for item in self.items["template"].values():
            if ext.lower() in (e.lower() for e in item.extensions):
                return item
        return None

    def listing(self, spark: SparkSession) -> DataFrame:
        rows = [(kind, name) for kind, known in self.items.items() for name in known]
        return spark.createDataFrame(rows, "kind string, name string")

    def lineage_rules(self, spark: SparkSession) -> DataFrame:
        """One row per input and output rep of every step."""
        rows = [
            (s.name, s.input_format, s.output_format, s.index_mode, before, after)
            for s in self.items["step"].values()
            for before in s.required_input_reps
            for after in s.output_reps
        ]
        return spark.createDataFrame(
            rows,
            "step string, input_format string, output_format string, index_mode string, "
            "input_rep string, output_rep string",
        )

    def ext_routes(self, spark: SparkSession) -> DataFrame:
        rows = [
            (ext.lower(), self.get("step", t.step).input_format, t.entity_type)
            for t in self.items["template"].values()
            for ext in t.extensions
        ]
        return spark.createDataFrame(rows, "ext string, format string, entity_type string")


def needs_converter(name: str) -> StepFn:
    """A step whose converter the user has to plug in."""

    def transform(df: DataFrame) -> DataFrame:
        raise NotImplementedError(f"step {name!r} has no converter; register one")

    return transform


def builtin_registry() -> Registry:
    """The built-in steps, the Markdown template and the chunk index."""
    from tarn.operators.search import search

    reg = Registry()
    for name, before, after, mode, input_rep, output_rep in LINEAGE_STEPS:
        passes = name == "md_passthru"
        reg.register(
            Step(name, before, after, (input_rep,), (output_rep,),
                 (lambda df: df) if passes else needs_converter(name), mode)
        )
    reg.register(Template("markdown", (".md", ".markdown", ".txt", ".html"), "document", "md_passthru"))
    reg.register(IndexTemplate("chunks", lambda chunks: chunks, search))
    return reg
