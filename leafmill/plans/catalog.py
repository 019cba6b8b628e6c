"""All registered queries of the library's own operators, with their SQL for the check."""

from __future__ import annotations

from leafmill.plans import context, documents, folds, latex, layout, pages, profile, quality, reading, relational, rescue, rules, sections, segmentation, splits, textual, variants

PLANS = textual.QUERIES | relational.QUERIES | rules.QUERIES | layout.QUERIES | context.QUERIES | pages.QUERIES | quality.QUERIES
QUERIES = dict(PLANS) | sections.QUERIES | folds.QUERIES | pages.FOLDS | documents.QUERIES | segmentation.QUERIES | rescue.QUERIES | latex.QUERIES | reading.QUERIES | splits.QUERIES | profile.QUERIES | variants.QUERIES
ORACLES = {k: p.sql.d for k, p in PLANS.items()} | sections.ORACLES | folds.ORACLES | documents.ORACLES | pages.FOLD_ORACLES | segmentation.ORACLES | rescue.ORACLES | latex.ORACLES | reading.ORACLES | splits.ORACLES | profile.ORACLES | variants.ORACLES
