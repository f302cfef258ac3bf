"""python -m lumenframe data list | data path NAME | queries | run NAME SF_DIR | pipeline FOLDER STORE"""

from __future__ import annotations

import sys


def main(args: list[str]) -> int:
    from .sources import datasets

    match args:
        case ["data", "list"]:
            print("\n".join(datasets.names()))
        case ["data", "path", name]:
            print(datasets.path(name))
        case ["queries"]:
            from .plans.catalog import QUERIES

            print("\n".join(QUERIES))
        case ["run", name, sf_dir]:
            from pyspark.sql import SparkSession

            from .plans.catalog import QUERIES

            QUERIES[name](SparkSession.builder.getOrCreate(), sf_dir).show()
        case ["pipeline", folder, store]:
            from pyspark.sql import SparkSession

            from .plans import pipeline
            from .sources import video

            spark = SparkSession.builder.getOrCreate()
            out = pipeline.run(spark, video.load_videos(spark, folder), store)
            print({k: v.count() for k, v in out.items() if v is not None})
        case _:
            print(__doc__)
            return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
