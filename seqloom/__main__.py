from seqloom.plans.cli import main

main()
