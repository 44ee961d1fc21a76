"""Named queries over the driver's tables, with their SQL."""

from talkgrid.plans import attribution, folds, measures, people, placement, reports, scores, streams, texts, timeline

_PLANS = (timeline, texts, measures, folds, scores, attribution, reports, streams, placement, people)
QUERIES: dict = {name: query for plan in _PLANS for name, query in plan.QUERIES.items()}
ORACLE_SQL: dict = {name: text for plan in _PLANS for name, text in plan.ORACLE_SQL.items()}
