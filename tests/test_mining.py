from spanledger.operators import mining as M

PAGES = [
    (1, "NAME\n  x - y\nSOURCE OPTIONS\n  -a, --all\n      All.\nFILTER OPTIONS\n  -b FILE\n      B.\n\n  not a term at all because it is long\n\nDESCRIPTION\n  -c\n"),
    (2, "DESCRIPTION\n\n    AllowGroups name\n        Text here.\n\n    Banner\n        Set -q now.\n\nDESCRIPTION\n\n    Other\n"),
    (3, "FIRST THINGS\n  -n\n\n  -m\n     deeper\n"),
    (4, "no headings\n\n  -z\n"),
    (5, "DESCRIPTION\n  If -P is given with --quiet it is\n  silent, see -P.\n"),
]


def test_definition_lists(spark):
    pages = spark.createDataFrame(PAGES, "page int, text string")
    got = sorted((r.page, r.names, r.takes_arg, r.kind) for r in M.definition_list(pages, "page", "text").collect())
    assert got == [(1, "-a,--all", False, "term"), (1, "-b", True, "term"), (2, "AllowGroups", True, "term"),
                   (2, "Banner", False, "term"), (3, "-m", False, "term"), (4, "-z", False, "term"),
                   (5, "--quiet, -P", False, "hint")]


def test_section_commands(spark):
    pages = spark.createDataFrame([(1, "tool", "SYNOPSIS\n  tool [x]\nEXAMPLES\n  sudo tool -a\n  ls\n\nNOTES\n  tool -b\n"),
                                   (2, "aid", "usage: aid [-h]\nmore\n")], "page int, own string, text string")
    got = sorted((r.page, r.section, r.command, r.taken) for r in M.section_commands(pages, "page", "text", "own").collect())
    assert got == [(1, "EXAMPLES", "ls", False), (1, "EXAMPLES", "sudo tool -a", True), (1, "SYNOPSIS", "tool [x]", True),
                   (2, "USAGE", "aid [-h]", True)]
