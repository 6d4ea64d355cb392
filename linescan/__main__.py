import sys

from linescan.cli import main

sys.exit(main())
