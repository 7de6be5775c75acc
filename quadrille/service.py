"""What a query endpoint needs: results by format, saved queries with parameters, and cancelling."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from .plans.compile import Engine, Result
from .sources import loader, results
from .terms import TYPE, Iri, Term, encode


@dataclass
class Service:
    """Queries over one engine. A run has a ticket; its Spark jobs carry it as a tag, so that it can be cancelled."""

    spark: SparkSession
    engine: Engine
    saved: dict[str, str] = field(default_factory=dict)

    def save(self, name: str, text: str) -> None:
        """A query text; ``$name$`` marks a parameter."""
        self.saved[name] = text

    def expand(self, name: str, /, **parameters: Term) -> str:
        """A saved query with its parameters as terms."""

        def value(m: re.Match) -> str:
            if m[1] not in parameters:
                raise KeyError(f"no value for {m[1]}")
            t = parameters[m[1]]
            if isinstance(t, tuple):
                text = t.lex.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")
                return f'"{text}"' + (f"^^<{t.dt}>" if t.dt else f"@{t.lang}" if t.lang else "")
            return encode(t)

        return re.sub(r"\$(\w+)\$", value, self.saved[name])

    def ticket(self) -> str:
        return f"query-{uuid.uuid4().hex}"

    def run(self, text: str, form: str = "json", ticket: str | None = None) -> str:
        """A query's result as json, xml or python; CONSTRUCT and DESCRIBE as n3, xml or nt."""
        tag = ticket or self.ticket()
        self.spark.addTag(tag)
        try:
            return self._shown(self.engine.query(text), form)
        finally:
            self.spark.removeTag(tag)

    def cancel(self, ticket: str) -> None:
        """Interrupts a run's jobs."""
        self.spark.interruptTag(ticket)

    @staticmethod
    def _shown(r: Result, form: str) -> str:
        if r.triples is not None:
            return loader.serialize(r.triples, "nt" if form == "json" else form)
        return {"json": results.to_json, "xml": results.to_xml, "python": lambda x: repr(results.to_python(x))}[form](r)

    def classes(self):
        """(class, instances) of the store."""
        t = self.engine.store.triples()
        return t.where(t.p == f"<{TYPE}>").groupBy(t.o.alias("class")).count().withColumnRenamed("count", "instances")

    def about(self, iri: str):
        """What the store says of a term."""
        return self.engine.query(f"DESCRIBE {encode(Iri(iri))}").triples
