from .text import *  # noqa: F401,F403
from .measures import *  # noqa: F401,F403
