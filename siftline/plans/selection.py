"""Runs to history report and to candidate selection, for every comparison group in one job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from siftline import config as cfg
from siftline.functions.durable import durable
from siftline.operators import comparison, selection


def history_report(
    runs: DataFrame, limits: cfg.HistoryThresholds | None = None
) -> DataFrame:
    """One row per comparison group: contract, best runs, trade-offs and advice."""
    groups = comparison.summarize_groups(comparison.comparison_cells(runs))
    advised = comparison.with_advice(groups, limits or cfg.HistoryThresholds())
    return comparison.with_tradeoffs(advised)


@dataclass(frozen=True)
class Selection:
    """The tables of one selection pass."""

    groups: DataFrame
    evaluations: DataFrame
    guard: DataFrame
    report: DataFrame

    @property
    def transitions(self) -> DataFrame:
        return selection.status_transitions(self.evaluations, self.report)

    @property
    def lifecycle(self) -> DataFrame:
        return selection.lifecycle(self.report)


def select_candidates(
    runs: DataFrame,
    artifacts: DataFrame,
    baselines: DataFrame,
    policy: cfg.SelectionPolicy | None = None,
    contract: cfg.EvidenceContract | None = None,
) -> Selection:
    """Gate, select and guard the candidates of all groups."""
    policy = policy or cfg.SelectionPolicy()
    cells = comparison.comparison_cells(runs)
    groups = comparison.summarize_groups(cells)
    slim = runs.drop("params", "metrics", "tags")
    kept = comparison.complete_runs(slim, cells)
    evidence = selection.check_evidence(runs, artifacts, contract or cfg.EvidenceContract())
    # The evaluations feed the winner, the transitions and the lifecycle; they are made once.
    evaluations = durable(selection.evaluate_candidates(kept, evidence, baselines, slim, policy))
    current = selection.current_candidates(comparison.usable_groups(runs))
    guard = selection.baseline_guard(baselines, current)
    report = selection.selection_report(groups, guard, selection.select_candidates(evaluations))
    return Selection(groups, evaluations, guard, report)
