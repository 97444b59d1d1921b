"""Check the queries of some plan modules: python tests/check_module.py numbers ..."""

import sys

sys.path.insert(0, ".")
sys.path.insert(0, "tests")

import check_all  # noqa: E402
from tabella.plans import registry  # noqa: E402

registry.load_all()
picked = [n for n, f in registry.QUERIES.items() if f.__module__.rsplit(".", 1)[1] in sys.argv[1:]]
real = check_all.entry.queries()
check_all.entry.queries = lambda: {n: real[n] for n in picked}
sys.argv = ["check"]
sys.exit(1 if check_all.main() else 0)
