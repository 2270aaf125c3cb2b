"""What a Python worker keeps from task to task."""

from __future__ import annotations

import sys
from collections.abc import Callable
from types import ModuleType
from typing import TypeVar

T = TypeVar("T")
HOME = "_lumifield_kept"  # a module that each worker makes for itself
MOST = 2


def kept(kind: str, path: str, make: Callable[[str], T]) -> T:
    """``make(path)``, made once by each Python worker; of a kind, the last two paths are kept.

    Functions travel with their code, so a task's modules are its own and new each time, and a cache around a function
    would have to be imported from this package, which workers need not have. So it is kept in a module of the worker.
    """
    own = vars(sys.modules.setdefault(HOME, ModuleType(HOME))).setdefault(kind, {})
    own[path] = own.pop(path) if path in own else make(path)
    while len(own) > MOST:
        del own[next(iter(own))]
    return own[path]
