"""Where the tables of a knowledge base lie: one root, one folder for each table."""

from __future__ import annotations

from dataclasses import dataclass, field

TABLES = [
    "entities", "ontology", "nodes", "edges", "metadata", "surface_manifest", "recording_map", "repair_report", "fold_manifest",
    "graph_vectors", "audio_vectors", "language_vectors", "predictions", "metrics", "retrieval_metrics", "wikipedia_manifest",
]


@dataclass(frozen=True)
class Locations:
    root: str
    overrides: dict[str, str] = field(default_factory=dict)

    def of(self, table: str, run_tag: str | None = None) -> str:
        """The folder of a table, or of one run of it."""
        if table not in TABLES:
            raise KeyError(table)
        base = self.overrides.get(table, f"{self.root.rstrip('/')}/{table}")
        return f"{base}/run_tag={run_tag}" if run_tag else base
