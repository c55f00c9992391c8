"""Plug-ins as table functions: a Python class, registered by name, is used in SQL like a table.

A splitter or an extractor turns one row into many (``LATERAL name(column)``). A group function reads the ordered rows of
one key after the other (``name(TABLE(rows) PARTITION BY key ORDER BY place)``) and keeps its state for that key only.
"""

from __future__ import annotations

import abc
from collections.abc import Iterable, Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from corpusmill.operators.chunking import python_splitter, register_splitter
from corpusmill.sources.readers import EXTRACTORS

PIECES = "ordinal int, page_content string, metadata map<string,string>"
EXTRACTIONS = "method string, priority int, text string"


class SplitterPlugin(abc.ABC):
    """Base of splitters. ``config_schema`` names the settings: {name: {"type", "label", "help_text", "required"}}."""

    name: str = ""
    help_text: str = ""
    config_schema: dict | None = None

    def __init__(self, config: dict):
        if not isinstance(self.config_schema, dict):
            raise TypeError(f"{type(self).__name__} needs a config_schema")
        missing = [k for k, field in self.config_schema.items() if field.get("required") and k not in config]
        unknown = [k for k in config if k not in self.config_schema]
        if missing or unknown:
            raise ValueError(f"settings of {type(self).__name__}: missing {missing}, unknown {unknown}")
        self.config = config

    @abc.abstractmethod
    def split(self, metadata: dict, text: str) -> Iterable[tuple[str, dict]]:
        """(text, metadata) of every piece."""


class GroupPlugin(abc.ABC):
    """Base of functions over the ordered rows of a key; a new object is made for every key."""

    schema: str = ""

    @abc.abstractmethod
    def row(self, row: Row) -> Iterable[tuple]:
        """What this row brings forth."""

    def end(self) -> Iterable[tuple]:
        """What is left after the last row."""
        return ()


SPLITTER_PLUGINS: dict[str, type[SplitterPlugin]] = {}


def register_splitter_plugin(plugin: type[SplitterPlugin], config: dict | None = None) -> str:
    """Make a splitter known to chunk jobs under its full name, which must be free; settings are checked at once."""
    name = f"{plugin.__module__}.{plugin.__qualname__}"
    if name in SPLITTER_PLUGINS:
        raise ValueError(f"{name} is registered already")
    checked = plugin(config or {})
    SPLITTER_PLUGINS[name] = plugin
    register_splitter(name, python_splitter(lambda text, own: checked.split({}, text)))
    return name


def splitter_function(spark: SparkSession, name: str, plugin: type[SplitterPlugin], config: dict | None = None) -> None:
    """``LATERAL name(text, metadata)``: the pieces of a text, their metadata laid over the given one."""
    plugin(config or {})

    class Split:
        def __init__(self):
            self.plugin = plugin(config or {})

        def eval(self, text: str, metadata: dict) -> Iterator[tuple]:
            if text is not None:
                own = metadata or {}
                for ordinal, (piece, extra) in enumerate(self.plugin.split(dict(own), text)):
                    yield ordinal, piece, own | extra

    spark.udtf.register(name, udtf(Split, returnType=PIECES))


def extractor_function(spark: SparkSession, name: str = "extracted") -> None:
    """``LATERAL name(content, extension)``: a candidate text by every registered extractor of the extension."""
    chosen = dict(EXTRACTORS)

    class Extract:
        def eval(self, content: bytes, extension: str) -> Iterator[tuple]:
            for method, (priority, extensions, extractor) in chosen.items():
                if extension in extensions and content is not None:
                    try:
                        yield method, priority, extractor(bytes(content))
                    except Exception:  # a broken file has no text by this method
                        yield method, priority, None

    spark.udtf.register(name, udtf(Extract, returnType=EXTRACTIONS))


def group_function(spark: SparkSession, name: str, plugin: type[GroupPlugin]) -> None:
    """``name(TABLE(rows) PARTITION BY key ORDER BY place)``: the plug-in's rows for every key."""

    class Group:
        def __init__(self):
            self.plugin = plugin()

        def eval(self, row: Row) -> Iterator[tuple]:
            yield from self.plugin.row(row)

        def terminate(self) -> Iterator[tuple]:
            yield from self.plugin.end()

    spark.udtf.register(name, udtf(Group, returnType=plugin.schema))
