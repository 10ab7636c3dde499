"""From requests and a catalog to bundles, manifests, totals and error reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from sheafwork.functions.paths import ROOT
from sheafwork.operators import bundles, reports, selection
from sheafwork.operators.cascade import Resolution, outcome_counts, resolution_status, resolve
from sheafwork.session import materialize


@dataclass(frozen=True)
class Assembly:
    """The outcome of a batch.  A request with a failed input has a report and no bundle."""

    resolution: Resolution
    files: DataFrame  #: chosen files of the requests that passed, numbered and measured
    bodies: DataFrame  #: path, hint, body
    max_depth: int | None

    def parts(self, part_bytes: int = bundles.PART_BYTES) -> DataFrame:
        return bundles.assemble_bundle(self.files, bundles.file_blocks(self.bodies), part_bytes)

    def manifest(self) -> DataFrame:
        return bundles.manifest(self.files, self.max_depth)

    def totals(self) -> DataFrame:
        return bundles.bundle_totals(self.files, self.max_depth)

    def status(self) -> DataFrame:
        return resolution_status(self.resolution)

    def outcome_counts(self) -> DataFrame:
        return outcome_counts(self.status())

    def report(self) -> DataFrame:
        return reports.error_report(self.resolution)


def assemble(
    requests: DataFrame, catalog: DataFrame, max_depth: int | None = None, root: str = ROOT
) -> Assembly:
    """Resolve the requests, choose their files and measure them.

    Content is read twice, once for the sizes and once for the blocks; that is less than to carry it
    through the numbering.  Outlines are dearer, so they are written once.  Only the content of files
    of requests that passed goes beyond the scan, if they are very many also a little more
    (``only_chosen``).
    """
    resolution = resolve(requests, catalog, root)
    chosen = materialize(selection.chosen_files(resolution), "chosen-files")
    bodies = bundles.content_or_error(bundles.only_chosen(catalog, chosen), max_depth)
    if max_depth is not None:
        bodies = materialize(bodies, "outlines")
    files = bundles.number_files(chosen, bundles.measure(bodies))
    return Assembly(resolution, files, bodies, max_depth)
