from ashgrid.functions.columns import *  # noqa: F401,F403
from ashgrid.functions.stats import *  # noqa: F401,F403
from ashgrid.functions.geo import *  # noqa: F401,F403
