"""python -m quillon list | run NAME TABLES OUT | explain NAME TABLES"""

import argparse

from quillon.session import session


def main() -> None:
    from quillon.plans import QUERIES

    parser = argparse.ArgumentParser(prog="quillon", description=__doc__)
    parser.add_argument("what", choices=["list", "run", "explain"])
    parser.add_argument("name", nargs="?", choices=sorted(QUERIES), metavar="NAME")
    parser.add_argument("tables", nargs="?", help="folder of the Parquet tables")
    parser.add_argument("out", nargs="?", help="folder for the result; without it the first rows are shown")
    parser.add_argument("--master", default="local[*]")
    parser.add_argument("--overwrite", action="store_true")
    a = parser.parse_args()
    if a.what == "list":
        print("\n".join(sorted(QUERIES)))
        return
    if not a.name or not a.tables:
        parser.error("a query and a folder of tables are needed")
    df = QUERIES[a.name](session(a.master), a.tables)
    if a.what == "explain":
        df.explain("formatted")
    elif a.out:
        from quillon.sources.sinks import export

        export(df, a.out, a.overwrite)
    else:
        df.show(20, False)


if __name__ == "__main__":
    main()
