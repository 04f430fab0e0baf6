"""Briefs of noisy tickets on Spark; see the README."""

from .functions.vocab import LEVELS
from .operators.export import rendered, to_json, to_markdown, write
from .plans.briefs import STAGES, Briefs, Stage, no_compressor
from .sources.tickets import Tickets, from_documents, from_json, from_json_files, from_pasted, from_tables, from_text_files, latest, raw_context, read_tickets

__all__ = [
    "LEVELS", "STAGES", "Briefs", "Stage", "Tickets", "from_documents", "from_json", "from_json_files", "from_pasted", "from_tables", "from_text_files", "latest", "no_compressor",
    "raw_context", "read_tickets", "rendered", "to_json", "to_markdown", "write",
]
