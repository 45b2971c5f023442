import sys

from stepweave.plans.analysis import main

sys.exit(main(sys.argv[1:]))
