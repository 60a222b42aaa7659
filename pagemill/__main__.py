import sys

from .local import main

sys.exit(main())
