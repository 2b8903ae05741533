"""The queries and the SQL of the operators in this subpackage."""

from . import bpe, html_extract, license_scan, line_dedup, near_dedup, packing, quality_classifier, quality_rules, topk_search, url_filter

_MODULES = (quality_classifier, topk_search, html_extract, url_filter, line_dedup, license_scan, bpe, near_dedup, packing, quality_rules)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
