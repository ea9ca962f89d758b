"""Query registry: importing this package registers every query module."""

from opsmill.plans import registry  # noqa: F401


def load_all():
    import importlib
    import pkgutil

    import opsmill.plans as pkg

    for m in pkgutil.iter_modules(pkg.__path__):
        if m.name.startswith("q_"):
            importlib.import_module(f"opsmill.plans.{m.name}")
    return registry
