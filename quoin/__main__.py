import sys

from quoin.cli import main

sys.exit(main())
