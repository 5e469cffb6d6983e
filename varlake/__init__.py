"""varlake: genetic-variant tables on Spark."""

from varlake.functions import *  # noqa: F401,F403
from varlake.operators import *  # noqa: F401,F403
from varlake.schema import *  # noqa: F401,F403
from varlake.sources import *  # noqa: F401,F403
