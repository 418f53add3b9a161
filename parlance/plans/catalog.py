"""All registered queries of the call operators."""

from . import act_queries, audio_queries, census_queries, extra_queries, fitted_queries, metric_queries, model_queries, report_queries, sequence_queries, stream_queries, text_queries

_MODULES = (text_queries, sequence_queries, metric_queries, act_queries, audio_queries, model_queries, extra_queries, report_queries, stream_queries, fitted_queries, census_queries)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
