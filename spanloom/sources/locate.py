"""Where references and germline files are; any file system that Spark reads."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Names the folder that holds a reference folder for each organism.
REFERENCES = "spark.spanloom.references"


def found(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern, in order; none is an empty list."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().toString() for s in system.globStatus(path) or [])


def gene_file(spark: SparkSession, root: str, species: str, group: str, gene: str) -> str:
    """The germline FASTA of a gene, such as root/Homo_sapiens/IG/IGHV.fasta, or in a single folder that wraps all of it."""
    part = f"{species}/{group}/{gene}.fasta"
    for pattern in (f"{root}/{part}", f"{root}/*/{part}"):
        paths = found(spark, pattern)
        if paths:
            return paths[0]
    raise FileNotFoundError(f"{part} under {root}")


def reference_folder(spark: SparkSession, organism: str) -> str:
    """An organism's reference folder, in the folder that the session's setting names."""
    root = spark.conf.get(REFERENCES, None) or spark.sparkContext.getConf().get(REFERENCES, None)
    if not root:
        raise RuntimeError(f"set {REFERENCES} to the folder of references")
    paths = found(spark, f"{root}/{organism}")
    if not paths:
        raise FileNotFoundError(f"{organism} under {root}")
    return paths[0]
