"""What users import: contracts, column functions, patterns, formats, generated cases."""

from .contract import Contract, Request, compile_contract
from .functions.exact import JSONError, Num, canonical, digest, equal, kind_of, parse
from .functions.formats import format_column, matches_format
from .functions.patterns import Pattern, PatternError, compile_pattern
from .generate.cases import Case, Obligation, Report, build, coverage, generate_cases, obligations
from .operators.columns import canonical_json, json_hash, strict_nodes
from .operators.evaluate import Violation, check_text
from .operators.nodes import node_table, rule_table, violations
from .operators.pairs import claims, path_captures, query_pairs, raw_path, raw_query, with_defaults
from .operators.typed import array_items, is_valid, table_violations, violation_counts
from .plans.wire import PathDecoder, QueryDecoder, WireError
from .sources.document import ContractError, Document
from .streaming.validate import validated_stream, written

__all__ = [
    "Case", "Contract", "ContractError", "Document", "JSONError", "Num", "Obligation", "PathDecoder", "Pattern", "PatternError", "QueryDecoder", "Report",
    "Request", "Violation", "WireError", "array_items", "build", "canonical", "canonical_json", "check_text", "claims", "compile_contract", "compile_pattern",
    "coverage", "digest", "equal", "format_column", "generate_cases", "is_valid", "json_hash", "kind_of", "matches_format", "node_table", "obligations", "parse",
    "path_captures", "query_pairs", "raw_path", "raw_query", "rule_table", "strict_nodes", "table_violations", "validated_stream", "violation_counts", "violations",
    "with_defaults", "written",
]
