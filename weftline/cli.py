"""Command lines: python -m weftline.cli word-count|inverted-index|pmi|road-speed|voronoi."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans import roads, texts, voronoi
from .session import local_session
from .sources import io


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="weftline", description="Ready-made pipelines over JSON lines.")
    commands = top.add_subparsers(dest="command", required=True)
    for name, about in (("word-count", "words and their counts"), ("inverted-index", "best documents of each word"), ("pmi", "most telling words of each document")):
        p = commands.add_parser(name, help=about)
        p.add_argument("--input", required=True, help="JSON lines with doc_id and text")
        p.add_argument("--output", default="-", help="folder for JSON lines, in files whose names are in the rows' order; - for standard output")
    p = commands.add_parser("road-speed", help="mean speed by weekday and hour")
    p.add_argument("--travel-times", required=True)
    p.add_argument("--edges", required=True)
    p.add_argument("--output", default="-")
    p = commands.add_parser("voronoi", help="cells of points in a rectangle")
    p.add_argument("--input", required=True, help="text: width, height, number of points, then x and y of each")
    p.add_argument("--output", default="-")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.getActiveSession() or local_session()
    if args.command == "road-speed":
        times = io.json_lines(spark, args.travel_times, "edge_id long, enter_time string, leave_time string")
        edges = io.json_lines(spark, args.edges, "edge_id long, start array<double>, end array<double>, length string")
        out = roads.road_speed(times, edges)
    elif args.command == "voronoi":
        width, height, points = io.field_and_points(spark, args.input)
        out = io.format_cells(voronoi.cells(points, width, height)).orderBy("id").select("line")
        if args.output == "-":
            for row in out.toLocalIterator():
                print(row[0])
        else:
            out.write.mode("overwrite").text(args.output)
        return
    else:
        docs = io.spread(io.json_lines(spark, args.input, "doc_id string, text string"))
        out = {"word-count": texts.word_count, "inverted-index": texts.inverted_index, "pmi": texts.pmi}[args.command](docs)
    io.write_json_lines(out, args.output)


if __name__ == "__main__":
    main()
