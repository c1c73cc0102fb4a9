"""Command line."""

import sys

from .plans.workflow import main

sys.exit(main())
