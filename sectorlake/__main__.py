"""python -m sectorlake COMMAND PATH [OUT]: info, list, types, md5 or extract for the images under a path."""

from __future__ import annotations

import sys


def main(args: list[str]) -> int:
    if len(args) < 2 or args[0] not in ("info", "list", "types", "md5", "extract") or (args[0] == "extract" and len(args) < 3):
        print(__doc__)
        return 2
    from pyspark.sql import SparkSession, functions as F

    from sectorlake import ship
    from sectorlake.operators import detect, volume
    from sectorlake.sources import images, sinks

    spark = SparkSession.builder.appName("sectorlake").getOrCreate()
    ship(spark)
    disks = images.images(spark, args[1])
    if args[0] == "info":
        out = disks.select("disk_id", "reject_reason").join(volume.disk_info(disks), "disk_id", "left")
    elif args[0] == "list":
        out = volume.tree(disks).orderBy("disk_id", "path")
    elif args[0] == "types":
        out = detect.detect_files(volume.files(disks))
    elif args[0] == "md5":
        out = disks.select("disk_id", "md5", "reject_reason")
    else:
        named = volume.files(disks).select(F.concat_ws("_", F.element_at(F.split("disk_id", "/"), -1), "path").alias("name"), "content")
        print(sinks.export(named, args[2]), "files")
        return 0
    out.show(1000, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
