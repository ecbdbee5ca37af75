"""Point-in-time factor analytics on Spark DataFrames."""

import tempfile
import zipfile
from pathlib import Path

__version__ = "0.1.0"

_SHIPPED: set[str] = set()


def ship(spark) -> None:
    """Send this package to the Python workers, once per application.

    Needed where the package is not installed on the workers; ``--py-files`` does the same.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    here = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="pitfactors-")) / "pitfactors.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(here.rglob("*.py")):
            z.write(file, file.relative_to(here.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)
