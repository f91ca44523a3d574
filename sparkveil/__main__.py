"""``python -m sparkveil``."""

import sys

from .cli import main

sys.exit(main())
