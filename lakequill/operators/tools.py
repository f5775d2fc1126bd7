"""Tools as SQL table functions: called by name with named arguments, also laterally for every row of a table.

Their bodies are queries over views, so that a lateral call is one joined plan, not a call a row.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakequill.operators.term_index import TermIndex

WORDS = r"array_distinct(filter(split(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), x -> x <> ''))"


@dataclass(frozen=True)
class Tool:
    """name(arguments: name -> (SQL type, default as SQL or None)) returns columns (name -> type)."""

    name: str
    description: str
    arguments: dict[str, tuple[str, str | None]]
    columns: dict[str, str]
    body: str

    def create(self, spark: SparkSession) -> None:
        given = ", ".join(f"{n} {kind}" + (f" DEFAULT {default}" if default else "") for n, (kind, default) in self.arguments.items())
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {self.name}({given}) RETURNS TABLE({', '.join(f'{c} {k}' for c, k in self.columns.items())}) RETURN {self.body}")

    def schema(self) -> str:
        """The arguments as JSON schema."""
        kinds = {"STRING": "string", "INT": "integer", "BIGINT": "integer", "DOUBLE": "number"}
        return json.dumps({
            "type": "object", "properties": {n: {"type": kinds[k]} for n, (k, _) in self.arguments.items()},
            "required": [n for n, (_, default) in self.arguments.items() if default is None]})


#: postings that have every word of q, the sum of each word's own score; passage is the text's first `most` characters
SEARCH = Tool(
    "search_documents", "Documents that have every word of the query, best first",
    {"q": ("STRING", None), "k": ("INT", "5"), "most": ("INT", "4000")}, {"doc_id": "BIGINT", "score": "DOUBLE", "passage": "STRING"},
    f"""SELECT f.doc_id, f.score, substring(d.text, 1, most) AS passage FROM (
  SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM (
    SELECT p.id AS doc_id, round(sum(0.1D * p.tf / (1 + 0.1D * p.tf)), 6) AS score, count(*) AS have, max(w.n) AS n
    FROM (SELECT explode(words) AS term, size(words) AS n FROM (SELECT {WORDS.format('q')} AS words)) w JOIN tool_postings p ON p.term = w.term GROUP BY p.id)
  WHERE have = n) f JOIN tool_documents d ON d.doc_id = f.doc_id WHERE f.place <= k""")
LIST = Tool(
    "list_documents", "Documents of a source, by id",
    {"of_source": ("STRING", None), "k": ("INT", "50")}, {"doc_id": "BIGINT", "n_chars": "BIGINT"},
    "SELECT doc_id, n_chars FROM (SELECT doc_id, n_chars, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM tool_documents) WHERE source = of_source AND place <= k")
READ = Tool(
    "read_document", "The text of one document, from a place on",
    {"id": ("BIGINT", None), "start": ("INT", "1"), "most": ("INT", "4000")}, {"doc_id": "BIGINT", "passage": "STRING"},
    "SELECT doc_id, substring(text, start, most) AS passage FROM tool_documents WHERE doc_id = id")
NOW = Tool("current_datetime", "The time of the query", {}, {"now": "STRING"}, "SELECT date_format(current_timestamp(), 'yyyy-MM-dd HH:mm:ss') AS now")


@dataclass
class Registry:
    """Tools of a session, by name."""

    spark: SparkSession
    tools: dict[str, Tool] = field(default_factory=dict)

    def add(self, tool: Tool) -> None:
        tool.create(self.spark)
        self.tools[tool.name] = tool

    def remove(self, name: str) -> bool:
        if self.tools.pop(name, None) is None:
            return False
        self.spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {name}")
        return True

    def catalog(self) -> DataFrame:
        """name, description, parameters (JSON schema)."""
        return self.spark.createDataFrame([(t.name, t.description, t.schema()) for t in self.tools.values()], "name string, description string, parameters string")

    def call(self, name: str, arguments: dict) -> DataFrame:
        """The rows that a tool gives. Arguments that it doesn't have are dropped; a missing one or an unknown tool is an error."""
        if name not in self.tools:
            raise KeyError(f"no tool {name}")
        known = {n: v for n, v in arguments.items() if n in self.tools[name].arguments}
        absent = [n for n, (_, default) in self.tools[name].arguments.items() if default is None and n not in known]
        if absent:
            raise TypeError(f"{name} needs {', '.join(absent)}")
        return self.spark.sql(f"SELECT * FROM {name}({', '.join(f'{n} => :{n}' for n in known)})", known)

    def lateral(self, rows: DataFrame, name: str, **arguments: str) -> DataFrame:
        """rows with what a tool gives for each; arguments are SQL expressions over the rows (as r)."""
        given = ", ".join(f"{n} => {e}" for n, e in arguments.items())
        return self.spark.sql(f"SELECT r.*, t.* FROM {{rows}} AS r, LATERAL {name}({given}) AS t", rows=rows)


def register(spark: SparkSession, docs: DataFrame, index: TermIndex) -> Registry:
    """The built-in tools over docs (doc_id, text, source, n_chars) and the index of their texts.

    They are temporary views and functions of the session; registering again replaces them.
    """
    docs.select("doc_id", "text", "source", "n_chars").createOrReplaceTempView("tool_documents")
    held = index.rows().select("term", F.explode(F.arrays_zip("ids", "positions")).alias("x"))
    held.select("term", F.col("x.ids").alias("id"), F.size("x.positions").alias("tf")).createOrReplaceTempView("tool_postings")
    out = Registry(spark)
    for tool in (SEARCH, LIST, READ, NOW):
        out.add(tool)
    return out
