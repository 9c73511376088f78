"""Every module of the package has the names that its functions use, also those that no import runs."""

import builtins
import dis
import importlib
import pkgutil
import types

import pytest

import tickloom

MODULES = sorted(m.name for m in pkgutil.walk_packages(tickloom.__path__, "tickloom."))


def used(code):
    """Names that the code and all functions within it look up in the module."""
    names = {i.argval for i in dis.get_instructions(code) if i.opname == "LOAD_GLOBAL"}
    return names.union(*[used(c) for c in code.co_consts if isinstance(c, types.CodeType)])


@pytest.mark.parametrize("name", MODULES)
def test_names_are_known(name):
    module = importlib.import_module(name)
    assert not used(module.__spec__.loader.get_code(name)) - set(vars(module)) - set(dir(builtins))
