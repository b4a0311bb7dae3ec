"""Siftloom: web-document analytics on Spark."""

from __future__ import annotations

import os
import tempfile
import zipfile

_SHIPPED: set[str] = set()


def ship(spark) -> None:
    """Make this package importable for Python workers, once per application.

    Workers of a local session start in an unknown folder, so the package's
    place is put on their path; for a cluster the package is sent as a zip file.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    here = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(here)
    if sc.master.startswith("local"):
        known = sc.environment.get("PYTHONPATH", "")
        sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)
        return
    path = os.path.join(tempfile.mkdtemp(prefix="siftloom-"), "siftloom.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(here):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
